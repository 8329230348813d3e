"""Queries of the job summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import jobs as j
from stowage.queries.registry import query
from stowage.sources.tables import SRC_SQL, TRANSFERS_SQL, source_inventory, table, transfers

_SUMMARY = """select {k}, count(*) as total, count(*) filter (entity_type = 'File') as files, count(*) filter (entity_type = 'Folder') as folders, count(*) filter (entity_type = 'Symlink') as symlinks,
  cast(0 as bigint) as hardlinks, count(*) filter (status = 2) as completed, count(*) filter (status in (-1, -2, -5)) as failed, count(*) filter (status in (-3, -4)) as skipped,
  cast(sum(size) as bigint) as bytes_enumerated, cast(coalesce(sum(size) filter (status not in (-1, -2, -5, -3, -4)), 0) as bigint) as bytes_expected, cast(coalesce(sum(size) filter (status = 2), 0) as bigint) as bytes_transferred,
  bool_and(status in (2, -1, -2, -5, -3, -4, -6)) as all_done from transfers group by {k}"""
_STATUS = """case when not all_done then 'InProgress' when failed > 0 and skipped > 0 then 'CompletedWithErrorsAndSkipped' when failed > 0 and completed > 0 then 'CompletedWithErrors'
  when failed > 0 then 'Failed' when skipped > 0 then 'CompletedWithSkipped' else 'Completed' end"""


@query("A5", "A6", "A7", sql=f"with {TRANSFERS_SQL}, s as ({_SUMMARY.format(k='job_id')}) select *, round(case when bytes_expected = 0 then 100.0 else least(100.0, 100.0 * bytes_transferred / bytes_expected) end, 6) as percent, {_STATUS} as job_status from s")
def job_summary(spark, sf):
    return j.job_summary(transfers(spark, sf))


@query("A7", "F22", sql=f"with {TRANSFERS_SQL}, s as ({_SUMMARY.format(k='job_id')}) select {_STATUS} as job_status, count(*) as jobs, cast(sum(total) as bigint) as transfers from s group by 1")
def job_statuses(spark, sf):
    return j.job_summary(transfers(spark, sf)).groupBy("job_status").agg(F.count("*").alias("jobs"), F.sum("total").alias("transfers"))


_PARTS = f"""{TRANSFERS_SQL}, parts as (select job_id, line - 1 as part_num, count(*) as total, count(*) filter (entity_type = 'File') as files, count(*) filter (entity_type = 'Folder') as folders, cast(sum(size) as bigint) as bytes,
  count(*) filter (status = 2) as completed, count(*) filter (status in (-1, -2, -5)) as failed, count(*) filter (status in (-3, -4)) as skipped, count(*) filter (status in (2, -1, -2, -5, -3, -4, -6)) as done from transfers group by all)"""


def _parts(spark, sf):
    return j.part_counters(transfers(spark, sf).withColumn("part_num", (F.col("line") - 1).cast("int")))


@query("A3", "A8", sql=f"with {_PARTS} select * from parts")
def part_counters(spark, sf):
    return _parts(spark, sf)


@query("A9", sql=f"with {_PARTS} select job_id, count(*) as parts, cast(sum(total) as bigint) as total, cast(sum(bytes) as bigint) as bytes, cast(sum(completed) as bigint) as completed, cast(sum(failed) as bigint) as failed, cast(sum(skipped) as bigint) as skipped, bool_or(part_num = 6) and bool_and(done = total) as complete from parts group by job_id")
def job_rollup(spark, sf):
    parts = _parts(spark, sf)
    return j.rolled_up(parts, table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit(6).alias("part_num")))


@query("A10", sql=f"with {_PARTS} select job_id, coalesce(bool_and(done = total) filter (part_num < 4), true) as links_may_start from parts group by job_id")
def links_gate(spark, sf):
    return j.links_may_start(_parts(spark, sf).withColumn("part_class", (F.col("part_num") >= 4).cast("int")))


@query("A21", "Z15", sql=f"with {TRANSFERS_SQL}, s as ({_SUMMARY.format(k='job_id')}) select job_id, total - folders - hardlinks as files_only, completed || ' done, ' || failed || ' failed, ' || skipped || ' skipped of ' || total as line from s")
def printed_counts(spark, sf):
    return j.printed_counts(j.job_summary(transfers(spark, sf)))


@query("A17", sql=f"with {TRANSFERS_SQL}, s as ({_SUMMARY.format(k='job_id')}) select job_id, case when files > 0 then bytes_enumerated // files else 0 end as bytes_per_file from s")
def mean_file_sizes(spark, sf):
    return j.mean_file(j.job_summary(transfers(spark, sf)))


@query("A23", sql=f"with {TRANSFERS_SQL}, s as ({_SUMMARY.format(k='job_id')}) select job_id, case when bytes_transferred + 20000000 <= bytes_expected then bytes_transferred + 20000000 else bytes_transferred end as bytes from s")
def bytes_with_active(spark, sf):
    s = j.job_summary(transfers(spark, sf))
    return s.select("job_id", j.with_active_bytes(F.col("bytes_transferred"), F.lit(20_000_000), F.col("bytes_expected")).alias("bytes"))


@query("A20", sql=f"""with {SRC_SQL}, r as (select container, 'top/' || relative_path as p, doc_id % 9 <> 0 as deleted from src),
a as (select container, 'top' as folder, deleted from r union all select container, 'top/' || split_part(p, '/', 2), deleted from r)
select container, folder, count(*) as descendants, bool_and(deleted) as deletable from a group by all""")
def folder_cascade(spark, sf):
    rows = source_inventory(spark, sf)
    return j.deletable_folders(rows.select("container", F.concat(F.lit("top/"), "relative_path").alias("relative_path"), (F.col("doc_id") % 9 != 0).alias("deleted")))


@query("T6", "T7", sql="""with e as (select user_id, ts, event_id, case event_type when 'error' then -1 when 'purchase' then 2 when 'click' then 1 else 0 end as status, case when event_type = 'error' then cast(floor(value) as integer) else 0 end as error_code from events)
select user_id, coalesce(arg_min(status, ts) filter (status <= -1 or status = 2), arg_max(status, ts)) as status, coalesce(arg_min(error_code, ts) filter (error_code <> 0), 0) as error_code from e group by user_id""")
def locked_statuses(spark, sf):
    e = table(spark, sf, "events")
    t = F.col("event_type")
    status = F.when(t == "error", -1).when(t == "purchase", 2).when(t == "click", 1).otherwise(0)
    rows = e.select("user_id", "ts", "event_id", status.alias("status"), F.when(t == "error", F.floor("value").cast("int")).otherwise(0).alias("error_code"))
    return j.first_locked(rows, "user_id")
