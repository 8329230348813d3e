"""Reconciliation of hard-link groups: two inode columns, a handful of aggregates, one CASE.

Rows of either side: relative_path, entity_type, inode, size, md5, last_modified. A group is the set of hard links with
one inode; its anchor is the least path by bytes. Inodes of the two sides are never mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.operators.reconcile import newer, reason


def linked(rows: DataFrame) -> Column:
    return (F.col("entity_type") == "Hardlink") & F.col("inode").isNotNull()


def _spread(key: Column) -> Column:
    """A join key of its own for each row without one, that nothing else has: such rows are most, and would all meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.col("relative_path")))


def anchors(rows: DataFrame) -> DataFrame:
    """H1: inode, anchor."""
    return rows.where(linked(rows)).groupBy("inode").agg(F.min("relative_path").alias("anchor"))


def last_records(records: DataFrame) -> DataFrame:
    """H3: of an inode's stored records the last one stands. records: inode, offset, first_path, anchor."""
    return records.groupBy("inode").agg(F.max_by(F.struct("first_path", "anchor"), "offset").alias("r")).select("inode", "r.*")


def with_targets(rows: DataFrame) -> DataFrame:
    """Adds target: the anchor's path for the other members of a group, NULL for the anchor itself and for other rows."""
    a = anchors(rows).withColumnRenamed("inode", "of")
    joined = rows.withColumn("key", _spread(F.when(linked(rows), F.col("inode")))).join(a, F.col("key") == F.col("of"), "left")
    return joined.withColumn("target", F.when(F.col("relative_path") != F.col("anchor"), F.col("anchor"))).drop("anchor", "key", "of")


def group_facts(src: DataFrame, dst: DataFrame) -> DataFrame:
    """H4-H9: one row for each destination hard link with all that its decision needs."""
    s = src.select(
        "relative_path", F.lit(True).alias("present"), F.when(linked(src), F.col("inode")).alias("s_inode"), F.col("size").alias("s_size"), F.col("md5").alias("s_md5"), F.col("last_modified").alias("s_time"),
    )
    d = dst.where(linked(dst)).select("relative_path", F.col("inode").alias("d_inode"), F.col("size").alias("d_size"), F.col("md5").alias("d_md5"), F.col("last_modified").alias("d_time"))
    m = d.join(s, "relative_path", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    independent = dst.where("entity_type = 'File'").select("relative_path").join(s.where("s_inode is not null").select("relative_path", "s_inode"), "relative_path").select("s_inode").distinct()
    by_src = m.where("s_inode is not null").groupBy("s_inode").agg((F.min("d_inode") != F.max("d_inode")).alias("spans"))
    by_src = by_src.join(independent.withColumn("joins", F.lit(True)), "s_inode", "left").select("s_inode", (F.col("spans") | F.coalesce("joins", F.lit(False))).alias("merge"))
    regular = F.col("present") & F.col("s_inode").isNull()
    by_dst = m.groupBy("d_inode").agg(
        F.min("relative_path").alias("d_anchor"),
        F.coalesce(F.min("s_inode") != F.max("s_inode"), F.lit(False)).alias("split"),
        F.bool_or(~F.col("present")).alias("foreign"),
        F.when(F.count_if("present") == F.count_if(regular), F.min(F.when(regular, F.col("relative_path")))).alias("survivor"),
    )
    s_anchor = anchors(src).select(F.col("inode").alias("s_inode"), F.col("anchor").alias("s_anchor"))
    at_dst_anchor = s.select(F.col("relative_path").alias("d_anchor"), F.col("s_inode").alias("anchor_s_inode"))
    at_src_anchor = d.select(F.col("relative_path").alias("s_anchor"), F.col("d_inode").alias("anchor_d_inode"))
    of_src = by_src.join(s_anchor, "s_inode", "full").withColumnRenamed("s_inode", "s_key")
    at_src_anchor = at_src_anchor.withColumnRenamed("s_anchor", "a_key")
    return (
        m.withColumn("s_key", _spread(F.col("s_inode"))).join(of_src, "s_key", "left").join(by_dst, "d_inode").join(at_dst_anchor, "d_anchor", "left")
        .withColumn("a_key", _spread(F.col("s_anchor"))).join(at_src_anchor, "a_key", "left").drop("s_key", "a_key")
        .withColumn("merge", F.coalesce("merge", F.lit(False)))
    )


def link_plan(src: DataFrame, dst: DataFrame, compare: str = "none", mirror: bool = False) -> DataFrame:
    """relative_path, action (delete, replace, transfer, skip), reason, target for every destination hard link.

    compare: none (size, then time) or md5.
    """
    f = group_facts(src, dst)
    path, s_anchor, d_anchor = F.col("relative_path"), F.col("s_anchor"), F.col("d_anchor")
    is_regular = F.col("s_inode").isNull()
    survives = F.coalesce(F.col("survivor") == path, F.lit(False))
    moved = (
        F.coalesce(F.col("anchor_s_inode") != F.col("s_inode"), F.lit(False))  # the old anchor now belongs to another group
        | F.col("merge")
        | F.col("split")
        | F.coalesce(F.col("anchor_d_inode") != F.col("d_inode"), F.lit(False))  # the new anchor lies in another group
        | (F.col("anchor_d_inode").isNull() & F.col("foreign"))  # it isn't there, and this group has members that are gone
    )
    same_anchor = F.coalesce(s_anchor == d_anchor, F.lit(False))
    recreate = ~same_anchor & F.when(is_regular, ~survives).otherwise(moved)
    carries = F.coalesce(s_anchor == path, F.lit(False)) | (is_regular & survives)
    changed = F.col("merge") | F.col("split")
    later = newer(F.col("s_time"), F.col("d_time"))
    by_hash = F.lit(compare == "md5")
    decide = [
        (~F.col("present"), "delete", "link_gone"),
        (recreate, "replace", "link_target"),
        (~carries, "skip", "link_intact"),
        (changed, "transfer", "group_changed"),
        (F.lit(mirror), "transfer", "hash"),
        (by_hash & F.col("s_md5").isNull() & later, "transfer", "time_no_hash"),
        (by_hash & F.col("s_md5").isNull(), "skip", "skip_time_no_hash"),
        (by_hash & ~F.col("s_md5").eqNullSafe(F.col("d_md5")), "transfer", "hash"),
        (by_hash, "skip", "skip_hash"),
        (F.col("s_size") != F.col("d_size"), "transfer", "size"),
        (~is_regular & ~same_anchor, "skip", "link_intact"),
        (later, "transfer", "time"),
    ]
    action, why = F.when(decide[0][0], decide[0][1]), F.when(decide[0][0], reason(decide[0][2]))
    for c, a, r in decide[1:]:
        action, why = action.when(c, a), why.when(c, reason(r))
    target = F.when(F.col("present") & ~is_regular & (s_anchor != path), s_anchor)
    return f.select("relative_path", action.otherwise("skip").alias("action"), why.otherwise(reason("link_intact")).alias("reason"), target.alias("target"))


def target_path(destination_root: Column, relative: Column, destination: Column, target: Column) -> Column:
    """Where a link's target lies at the destination: the destination without the link's own path, then the target's."""
    root = F.when(destination.endswith(relative), F.substr(destination, F.lit(1), F.length(destination) - F.length(relative))).otherwise(destination_root)
    return F.concat(F.regexp_replace(root, "/$", ""), F.lit("/"), target)
