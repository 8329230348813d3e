"""Queries of the reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import reconcile as r
from stowage.operators.kept_index import KeptIndex
from stowage.queries.registry import query
from stowage.session import scratch
from stowage.sources.tables import DST_SQL, SRC_SQL, destination_inventory, source_inventory, table

_W = f"with {SRC_SQL}, {DST_SQL}"


def _q(name: str) -> str:
    return "'" + r.REASONS[name] + "'"


_LATER = "coalesce(s.last_modified > d.last_modified, false)"


def _plan_sql(compare: str, mirror: bool = False, extra: str = "delete") -> str:
    by_hash = "s.entity_type = 'File'" if compare == "md5" else "false"
    cases = [
        ("d.relative_path is null", "transfer", "only_source"),
        ("s.relative_path is null", extra, "only_destination"),
        (str(mirror).lower(), "transfer", "mirror"),
        (f"{by_hash} and s.md5 is null and {_LATER}", "transfer", "time_no_hash"),
        (f"{by_hash} and s.md5 is null", "skip", "skip_time_no_hash"),
        (f"{by_hash} and s.md5 is distinct from d.md5", "transfer", "hash"),
        (by_hash, "skip", "skip_hash"),
        (_LATER, "transfer", "time"),
    ]
    action = " ".join(f"when {c} then '{a}'" for c, a, _ in cases)
    why = " ".join(f"when {c} then {_q(x)}" for c, _, x in cases)
    return f"""{_W} select coalesce(s.container, d.container) as container, coalesce(s.relative_path, d.relative_path) as relative_path,
      case {action} else 'skip' end as action, case {why} else {_q("skip_time")} end as reason
      from src s full join dst d on s.container = d.container and s.relative_path = d.relative_path"""


def _sides(spark, sf):
    return source_inventory(spark, sf), destination_inventory(spark, sf)


@query("J1", "J3", "J4", "J7", "J10", "J8", sql=_plan_sql("md5"))
def sync_plan(spark, sf):
    """The flagship: one action and one reason for every key of either side."""
    return r.sync_plan(*_sides(spark, sf), unique=True)


@query("J3", "J10", sql=_plan_sql("time", extra="prompt"))
def sync_plan_by_time(spark, sf):
    return r.sync_plan(*_sides(spark, sf), compare="time", delete="prompt", unique=True)


@query("J4", "E16", sql=_plan_sql("md5", mirror=True, extra="keep"))
def sync_plan_mirror(spark, sf):
    return r.sync_plan(*_sides(spark, sf), mirror=True, delete="false", unique=True)


@query("J1", "A19", sql=f"with p as ({_plan_sql('md5')}) select action, reason, count(*) as n from p group by all")
def sync_summary(spark, sf):
    return r.sync_plan(*_sides(spark, sf), unique=True).groupBy("action", "reason").agg(F.count("*").alias("n"))


@query("J2", sql="""select container, path_key, max(last_modified) as last_modified from (select source as container, lower(lang || '/' || (doc_id % 40)) as path_key, timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute as last_modified from documents) group by all""")
def sync_index(spark, sf):
    """Keys listed more than once, in two spellings."""
    rows = source_inventory(spark, sf).withColumn("relative_path", F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper(F.substring_index("relative_path", "/", 1))).otherwise(F.substring_index("relative_path", "/", 1)), F.lit("/"), (F.col("doc_id") % 40).cast("string")))
    return r.indexed(rows, ignore_case=True).select("container", "path_key", "last_modified")


@query("J5", "U3", sql=f"{_W} select container, relative_path from src anti join dst using (container, relative_path)")
def only_in_source(spark, sf):
    src, dst = _sides(spark, sf)
    return r.only_in(src, dst).select("container", "relative_path")


@query("J6", "U3", sql=f"{_W} select container, relative_path from dst anti join src using (container, relative_path)")
def only_in_destination(spark, sf):
    src, dst = _sides(spark, sf)
    return r.only_in(dst, src).select("container", "relative_path")


@query("J7", "U4", sql=f"{_W} select container, relative_path, size from src semi join dst using (container, relative_path)")
def in_both_sides(spark, sf):
    return r.in_both(*_sides(spark, sf)).select("container", "relative_path", "size")


_PAGES = "pages_ as (select case when l_suppkey % 10 = 0 then -l_suppkey else l_suppkey end as k, cast(l_partkey as bigint) * 512 as start, cast(l_partkey as bigint) * 512 + cast(l_quantity as bigint) * 512 - 1 as stop from lineitem where l_linenumber % 2 = 1)"


@query("J9", sql=f"with {_PAGES}, r as (select distinct l_suppkey as k, cast(l_partkey as bigint) * 700 as start, cast(l_partkey as bigint) * 700 + 4095 as stop from lineitem where l_linenumber % 2 = 0), hit as (select distinct r.* from r join pages_ p on p.k = r.k and r.start <= p.stop and p.start <= r.stop) select * from hit union all select * from r where k not in (select k from pages_)")
def ranges_with_data(spark, sf):
    """Odd lines are pages with data, even lines ranges to test; a tenth of the ranges' objects have no pages listed."""
    li = table(spark, sf, "lineitem")
    k = F.when(F.col("l_suppkey") % 10 == 0, -F.col("l_suppkey")).otherwise(F.col("l_suppkey"))
    pages = li.where("l_linenumber % 2 = 1").select(k.alias("k"), (F.col("l_partkey") * 512).alias("start"), (F.col("l_partkey") * 512 + F.col("l_quantity").cast("long") * 512 - 1).alias("stop"))
    ranges = li.where("l_linenumber % 2 = 0").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 700).alias("start"), (F.col("l_partkey") * 700 + 4095).alias("stop")).distinct()
    return r.overlapping(pages, ranges, 32_768, ["k"])


@query("J11", sql=f"{_W} select s.container, s.relative_path, case when d.relative_path is null or s.last_modified > d.last_modified then 'transfer' else 'skip' end as action from src s left join dst d using (container, relative_path)")
def overwrite_if_newer(spark, sf):
    return r.overwrite_plan(*_sides(spark, sf), "ifSourceNewer")


@query("J11", sql=f"{_W} select s.container, s.relative_path, case when d.relative_path is null or s.entity_type = 'Folder' then 'transfer' else 'skip' end as action from src s left join dst d using (container, relative_path)")
def overwrite_posix(spark, sf):
    return r.overwrite_plan(*_sides(spark, sf), "posix")


@query("U1", sql=f"{_W} select container, count(*) as n from (select container from src union all select container from dst) group by container")
def union_of_scans(spark, sf):
    src, dst = _sides(spark, sf)
    return src.unionByName(dst).groupBy("container").agg(F.count("*").alias("n"))


_MERGED = _plan_sql("md5").replace("full join dst d", "full join kept d").replace(" select coalesce(s.container", """, kept as (select container, relative_path, entity_type, size, case when doc_id % 5 = 0 then null else md5 end as md5,
  case when doc_id % 5 = 0 then timestamp '2030-01-01 00:00:00' else last_modified end as last_modified, doc_id from dst where doc_id % 29 <> 3
  union all select 'new', 'fresh/' || doc_id, 'File', 1, 'x', timestamp '2024-01-01 00:00:00', doc_id from src where doc_id % 31 = 0) select coalesce(s.container""", 1)


@query("J1", "J2", sql=_MERGED)
def sync_with_kept_index(spark, sf):
    """The destination's index is stored, takes deletions, changes and new rows, and a second sync reads it as it lies."""
    src, dst = _sides(spark, sf)
    index = KeptIndex(spark, scratch(spark, "index"), buckets=16)
    index.store(dst)
    gone = dst.where("doc_id % 29 = 3").withColumn("deleted", F.lit(True))
    changed = dst.where("doc_id % 29 <> 3 and doc_id % 5 = 0").withColumns({"md5": F.lit(None).cast("string"), "last_modified": F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), "deleted": F.lit(False)})
    new = src.where("doc_id % 31 = 0").select(F.lit("new").alias("container"), F.concat(F.lit("fresh/"), F.col("doc_id").cast("string")).alias("relative_path"), "name", F.lit("File").alias("entity_type"), F.lit(1).cast("long").alias("size"), F.lit("x").alias("md5"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_modified"), "doc_id", F.lit(False).alias("deleted"))
    index.merge(gone.unionByName(changed).unionByName(new))
    return r.sync_plan(src, index.rows, unique=True)
