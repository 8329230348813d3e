"""Queries of the streaming operators: a file stream is taken to its end and the result returned."""

from __future__ import annotations

import contextlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.queries.registry import query
from stowage.session import shared_folder, stored
from stowage.sources.tables import SRC_SQL, chunk_log, source_inventory, table
from stowage.streaming import jobs as s
from stowage.streaming import live


def _events(spark, sf):
    """The pattern stands for the table, be it a file or a folder: a stream can't be pointed at a single file."""
    t = F.col("event_type")
    status = F.when(t == "error", -1).when(t == "purchase", 2).when(t == "signup", -3).otherwise(1)
    return s.events_stream(spark, f"{sf}/events.parque[t]").select(F.col("user_id").alias("job_id"), status.alias("status"), F.floor(F.col("value") * 100).cast("long").alias("size"), "ts", "event_id", "value")


_EV = "e as (select user_id as job_id, case event_type when 'error' then -1 when 'purchase' then 2 when 'signup' then -3 else 1 end as status, cast(floor(value * 100) as bigint) as size, ts, event_id, value from events)"


@query("A4", "T2", "K9", sql=f"with {_EV} select job_id, count(*) as total, count(*) filter (status = 2) as completed, count(*) filter (status = -1) as failed, count(*) filter (status = -3) as skipped, cast(coalesce(sum(size) filter (status <> -3), 0) as bigint) as bytes_expected, cast(coalesce(sum(size) filter (status = 2), 0) as bigint) as bytes_transferred from e group by job_id")
def stream_live_summary(spark, sf):
    return s.run_to_table(s.live_summary(_events(spark, sf)), "complete", shared_folder(spark))


@query("T2", sql=f"with {_EV} select job_id, event_id, status from e where status <= -1")
def stream_failures(spark, sf):
    return s.run_to_table(s.failure_feed(_events(spark, sf)).select("job_id", "event_id", "status"), "append", shared_folder(spark))


@query("T3", "W3", sql="select time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 4) as value from events group by 1")
def stream_report(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = s.run_to_table(s.windowed_report(e, "1 hour"), "complete", shared_folder(spark))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 4).alias("value"))


@query("T6", "T7", sql=f"with {_EV} select job_id, arg_min(status, ts) as status from e where status <= -1 or status = 2 group by job_id")
def stream_standing_status(spark, sf):
    return s.run_to_table(s.standing_status(_events(spark, sf)), "complete", shared_folder(spark))


@query("T1", "T4", "T5", "T12", sql="select cast(user_id as varchar) as name, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as seq from events")
def stream_in_sequence(spark, sf):
    """The chunks arrive in four files, out of order."""
    log = chunk_log(spark, sf)
    rows = log.withColumn("seq", (F.row_number().over(Window.partitionBy("name").orderBy("ts", "event_id")) - 1).cast("long")).select("name", "seq", "event_id")
    path = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    rows.repartition(4, F.xxhash64("event_id")).select("name", "seq").write.parquet(path)
    return s.run_to_table(s.in_sequence(s.events_stream(spark, path, files_per_trigger=1)), "append", shared_folder(spark))


@query("T11", "D3", sql=f"with {SRC_SQL} select container, relative_path from src where last_modified >= timestamp '2024-01-01 05:00:00' - interval 5 second")
def changed_since_bookmark(spark, sf):
    return s.since(source_inventory(spark, sf), "2024-01-01 05:00:00").select("container", "relative_path")


@query("T1", "K1", sql=f"with {SRC_SQL}, n as (select container as job_id, count(*) as n from src group by 1), p as (select job_id, n, unnest(range(0, cast(ceil(n / 100.0) as bigint))) as part_num from n) select job_id, part_num, least(100, n - 100 * part_num) as n_rows, part_num = ceil(n / 100.0) - 1 as is_final from p")
def stream_parts_of_arrivals(spark, sf):
    """The inventory arrives in four pieces; full parts are cut after each, the rest at the end."""
    rows = source_inventory(spark, sf).select(F.col("container").alias("job_id"), "relative_path", "size", "doc_id")
    run = live.PartsOfArrivals(spark, rows.schema, part_rows=100, lanes=4)
    for k in range(4):
        run.arrive(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k))
        run.advance()
    return run.finish().groupBy("job_id", "part_num").agg(F.count("*").alias("n_rows"), F.max("is_final").alias("is_final"))


_ASKED = {"view": 1, "click": 5, "signup": -3, "purchase": 2, "error": -1}
_MACHINE_SQL = """e as (select user_id, ts, event_id, event_id % 3 as batch, case event_type when 'view' then 1 when 'click' then 5 when 'signup' then -3 when 'purchase' then 2 else -1 end as asked from events),
s as (select b.batch, user_id, list_reduce(list_prepend(0, list(asked order by e.batch, ts, event_id)), lambda c, x: case when c = 2 then c when c <= -1 and x <> 5 then c else x end) as status
  from e join (values (0), (1), (2)) as b(batch) on e.batch <= b.batch group by b.batch, user_id)"""


def _asked(spark, sf):
    asked = F.create_map(*[F.lit(x) for pair in _ASKED.items() for x in pair])[F.col("event_type")]
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"), asked.cast("int").alias("status"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").cast("long").alias("event_id"))


def _each_batch(spark, sf, seen):
    """Three arrivals, and what is seen after each."""
    run, events, out = live.StateMachine(spark), _asked(spark, sf), []
    for k in range(3):
        run.arrive(events.where(f"event_id % 3 = {k}"))
        run.advance()
        out.append(stored(seen(run).select(F.lit(k).alias("batch"), "status", "n"), "seen"))
    return reduce(DataFrame.unionByName, out)


@query("T5", "T6", "T9", sql=f"with {_MACHINE_SQL} select cast(batch as integer) as batch, cast(status as integer) as status, count(*) as n from s group by all")
def stream_state_counters(spark, sf):
    """Counters by status after every batch, from the moves."""
    return _each_batch(spark, sf, lambda run: run.counters())


@query("T2", "T5", sql=f"with {_MACHINE_SQL} select cast(batch as integer) as batch, cast(status as integer) as status, count(*) as n from s group by all")
def stream_state_on_request(spark, sf):
    """The same counts, from the state itself, read between batches."""
    return _each_batch(spark, sf, lambda run: run.standing().groupBy("status").agg(F.count("*").alias("n")))


@query("T11", "D3", sql=f"with {SRC_SQL} select case when doc_id <= 60 then 0 else 1 end as run, container, relative_path from src where container is not null")
def bookmarked_runs(spark, sf):
    """Three starts an hour apart; the second fails after its rows are made, and the third takes them."""
    rows = source_inventory(spark, sf).where("container is not null").select("container", "relative_path", "last_modified")
    there = lambda until: rows.where(F.col("last_modified") <= F.lit(until).cast("timestamp_ntz"))
    runs = live.BookmarkedRuns(spark, f"{shared_folder(spark)}/bookmarks-{uuid.uuid4().hex}")
    runs.run(there("2024-01-01 01:00:00"), "2024-01-01 01:00:00")
    with contextlib.suppress(Exception):
        runs.run(there("2024-01-01 02:00:00"), "2024-01-01 02:00:00", lambda d: d.withColumn("size", F.raise_error(F.lit("lost")).cast("int")))
    runs.run(rows, "2024-02-01 00:00:00")
    return reduce(DataFrame.unionByName, [runs.rows_of(k).select(F.lit(k).alias("run"), "container", "relative_path") for k in range(2)])


@query("T3", sql="""with recursive j as (select event_type as job_id, list(cast(floor(epoch(ts)) as bigint) order by ts) as s from events group by 1),
r(job_id, t, n, total) as (select job_id, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from j
  union all select job_id, upto, told - total, told from (select job_id, total, upto, cast(len(list_filter(s, lambda x: x < upto)) as bigint) as told
    from (select job_id, total, s, t + ((s[total + 1] - t) // pace + 1) * pace as upto from (select *, case when total > 60 then 172800 else 21600 end as pace from r) join j using (job_id) where total < len(s))))
select job_id, make_timestamp(t * 1000000) as "at", n, total from r where n > 0""")
def stream_paced_report(spark, sf):
    """Each event type's progress: every six hours, every two days above sixty events."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    run = live.PacedReport(spark, fast=21_600, slow=172_800, limit=60)
    first, last = (F.lit(x) for x in events.agg(F.min("ts"), F.max("ts")).first())
    half = F.timestamp_seconds((F.unix_seconds(first) + F.unix_seconds(last)) / 2)
    for part in (events.where(F.col("ts") < half), events.where(F.col("ts") >= half)):
        run.arrive(part)
        run.advance()
    return run.finish().select("job_id", F.col("at").cast("timestamp_ntz").alias("at"), "n", "total")
