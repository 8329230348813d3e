"""Queries of the hard-link reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import hardlinks as h
from stowage.operators.reconcile import REASONS
from stowage.queries.registry import query
from stowage.sources.tables import table

_SIDES = """
b as (select lang || '/' || doc_id || '.txt' as relative_path, doc_id, text, n_chars, timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute as t from documents),
src as (select relative_path, case when doc_id % 10 = 0 then 'File' else 'Hardlink' end as entity_type, case when doc_id % 10 <> 0 then md5(text) end as inode, n_chars as size, t as last_modified from b where doc_id % 29 <> 0),
dst as (select relative_path, case when doc_id % 31 = 0 then 'File' else 'Hardlink' end as entity_type, case when doc_id % 31 <> 0 then case when doc_id % 5 = 4 then md5(text || 'z') else md5(text) end end as inode,
  n_chars + case when doc_id % 3 = 0 then 1 else 0 end as size, t + (doc_id % 3 - 1) * interval '1' day as last_modified from b where doc_id % 7 <> 0)"""


def _sides(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    path = F.concat("lang", F.lit("/"), k.cast("string"), F.lit(".txt"))
    t = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=k.cast("int"))
    src = d.where("doc_id % 29 <> 0").select(
        path.alias("relative_path"), F.when(k % 10 == 0, "File").otherwise("Hardlink").alias("entity_type"), F.when(k % 10 != 0, F.md5("text")).alias("inode"),
        F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("md5"), t.alias("last_modified"),
    )
    inode = F.when(k % 5 == 4, F.md5(F.concat("text", F.lit("z")))).otherwise(F.md5("text"))
    dst = d.where("doc_id % 7 <> 0").select(
        path.alias("relative_path"), F.when(k % 31 == 0, "File").otherwise("Hardlink").alias("entity_type"), F.when(k % 31 != 0, inode).alias("inode"),
        (F.col("n_chars") + F.when(k % 3 == 0, 1).otherwise(0)).alias("size"), F.lit(None).cast("string").alias("md5"), (t + F.make_dt_interval(days=(k % 3 - 1).cast("int"))).alias("last_modified"),
    )
    return src, dst


@query("H1", "H2", sql=f"with {_SIDES} select inode, min(relative_path) as anchor from src where inode is not null group by inode")
def link_anchors(spark, sf):
    return h.anchors(_sides(spark, sf)[0])


@query("H3", sql="select text_hash as inode, arg_max(doc_id, doc_id) as first_path from (select md5(text) as text_hash, doc_id from documents) group by 1")
def link_records(spark, sf):
    rows = table(spark, sf, "documents").select(F.md5("text").alias("inode"), F.col("doc_id").alias("offset"), F.col("doc_id").alias("first_path"), F.col("lang").alias("anchor"))
    return h.last_records(rows).select("inode", "first_path")


@query("H12", "H13", "H15", "Z6", sql=f"with {_SIDES} select s.relative_path, case when s.relative_path <> a.anchor then a.anchor end as target, case when s.relative_path <> a.anchor then '/dst/' || a.anchor end as target_path from src s left join (select inode, min(relative_path) as anchor from src where inode is not null group by inode) a using (inode)")
def link_targets(spark, sf):
    rows = h.with_targets(_sides(spark, sf)[0])
    p, t = F.col("relative_path"), F.col("target")
    return rows.select("relative_path", "target", h.target_path(F.lit("/dst"), p, F.concat(F.lit("/dst/"), p), t).alias("target_path"))


_R = {k: "'" + v.replace("'", "''") + "'" for k, v in REASONS.items()}


@query("H4", "H5", "H6", "H7", "H8", "H9", "H10", "H11", "H14", "H16", sql=f"""with {_SIDES},
d as (select relative_path, inode as d_inode, size as d_size, last_modified as d_time from dst where entity_type = 'Hardlink'),
m as (select d.*, s.relative_path is not null as present, s.inode as s_inode, s.size as s_size, s.last_modified as s_time from d left join src s using (relative_path)),
ind as (select distinct s.inode as s_inode from dst join src s using (relative_path) where dst.entity_type = 'File' and s.inode is not null),
bs as (select s_inode, count(distinct d_inode) > 1 or s_inode in (select s_inode from ind) as merge from m where s_inode is not null group by s_inode),
bd as (select d_inode, min(relative_path) as d_anchor, count(distinct s_inode) > 1 as split, bool_or(not present) as "foreign",
  case when count(*) filter (present) = count(*) filter (present and s_inode is null) then min(relative_path) filter (present and s_inode is null) end as survivor from m group by d_inode),
sa as (select inode as s_inode, min(relative_path) as s_anchor from src where inode is not null group by inode),
f as (select m.*, coalesce(merge, false) as merge, split, "foreign", d_anchor, survivor, s_anchor, x.inode as anchor_s_inode, y.d_inode as anchor_d_inode
  from m left join bs using (s_inode) join bd using (d_inode) left join sa using (s_inode) left join src x on x.relative_path = d_anchor left join d y on y.relative_path = s_anchor),
g as (select *, coalesce(s_anchor = d_anchor, false) as same, coalesce(survivor = relative_path, false) as survives,
  coalesce(anchor_s_inode <> s_inode, false) or merge or split or coalesce(anchor_d_inode <> d_inode, false) or (anchor_d_inode is null and "foreign") as moved from f),
z as (select *, not same and case when s_inode is null then not survives else moved end as recreate, coalesce(s_anchor = relative_path, false) or (s_inode is null and survives) as carries from g)
select relative_path, case when not present then 'delete' when recreate then 'replace' when not carries then 'skip' when merge or split then 'transfer' when s_size <> d_size then 'transfer'
  when s_inode is not null and not same then 'skip' when s_time > d_time then 'transfer' else 'skip' end as action,
case when not present then {_R['link_gone']} when recreate then {_R['link_target']} when not carries then {_R['link_intact']} when merge or split then {_R['group_changed']} when s_size <> d_size then {_R['size']}
  when s_inode is not null and not same then {_R['link_intact']} when s_time > d_time then {_R['time']} else {_R['link_intact']} end as reason,
case when present and s_inode is not null and s_anchor <> relative_path then s_anchor end as target from z""")
def link_plan(spark, sf):
    return h.link_plan(*_sides(spark, sf))
