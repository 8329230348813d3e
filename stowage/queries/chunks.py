"""Queries of chunk states, rates and advice."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.operators import chunklog as c
from stowage.queries.registry import query
from stowage.sources.tables import CHUNKS_SQL, chunk_log, table

_D = f"""{CHUNKS_SQL}, d as (select *, coalesce(epoch_us(lead(ts) over (partition by name, "offset" order by ts)) - epoch_us(ts), 0) / 1e6 as seconds from chunks),
f as (select *, (state = 'Body' and seconds > 30) or starts_with(state, 'BodyReRead') as is_long from d)"""


@query("W1", sql=f"with {_D} select name, state, ts, seconds, is_long from f")
def state_durations(spark, sf):
    return c.durations(chunk_log(spark, sf)).select("name", "state", "ts", "seconds", "is_long")


@query("W1", sql=f"with {_D} select state, count(*) as n, round(sum(seconds), 3) as seconds from f where name in (select name from f where is_long) group by state")
def slow_file_states(spark, sf):
    return c.slow_files(chunk_log(spark, sf)).groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


_NOW = f"{CHUNKS_SQL}, s as (select name, arg_max(state, ts) as state from chunks group by name)"


@query("A14", sql=f"with {_NOW} select * from s")
def current_states(spark, sf):
    return c.current_states(chunk_log(spark, sf)).select("name", "state")


@query("A13", sql=f"""with {_NOW}, n as (select case when starts_with(state, 'BodyReRead') then 'Body' else state end as state, count(*) as n from s group by 1)
select cast(place as integer) as place, state, coalesce(n, 0) as n from (values (0, 'RAM'), (1, 'Worker'), (2, 'FilePacer'), (3, 'HeaderResponse'), (4, 'Body'), (5, 'DiskIO'), (6, 'Sorting'), (7, 'PriorChunk'), (8, 'QueueToWrite'), (9, 'Done')) t(place, state) left join n using (state)""")
def state_counts(spark, sf):
    return c.state_counts(c.current_states(chunk_log(spark, sf)), "download")


@query("A15", "W4", sql=f"""with {_NOW} select case when (select count(*) from s where state = 'Sorting') > greatest(10, 5 * (select count(*) from s where state = 'Worker')) then 'Disk' else 'Unknown' end as "constraint" """)
def constraint(spark, sf):
    return c.primary_constraint(c.state_counts(c.current_states(chunk_log(spark, sf)), "download"), "download")


_REQ = """r as (select user_id, ts, value, case when event_type = 'error' then case when event_id % 4 = 0 then 'network_error' when event_id % 4 = 1 then 'busy_iops' when event_id % 4 = 2 then 'busy_throughput' else 'busy_other' end else 'ok' end as outcome from events)"""
_RATIOS = f"""{_REQ}, q as (select user_id, count(*) as operations, epoch_us(max(ts)) - epoch_us(min(ts)) as us, 100.0 * count(*) filter (outcome = 'network_error') / count(*) as ne, 100.0 * count(*) filter (starts_with(outcome, 'busy')) / count(*) as b,
 100.0 * count(*) filter (outcome = 'busy_iops') / count(*) as bi, 100.0 * count(*) filter (outcome = 'busy_throughput') / count(*) as bt, 100.0 * count(*) filter (outcome = 'busy_other') / count(*) as bo, cast(floor(avg(value)) as bigint) as mean_ms from r group by user_id)"""


def _ratios(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id") % 4
    kind = F.when(k == 0, "network_error").when(k == 1, "busy_iops").when(k == 2, "busy_throughput").otherwise("busy_other")
    return c.network_ratios(e.select("user_id", "ts", F.col("value").alias("ms"), F.when(F.col("event_type") == "error", kind).otherwise("ok").alias("outcome")), "user_id")


@query("A11", sql=f"with {_RATIOS} select user_id, operations, case when us > 0 then cast(floor(operations / (us / 1e6)) as bigint) else 0 end as iops, round(ne, 6) as network_error_pct, round(b, 6) as busy_pct, round(bi, 6) as busy_iops_pct, round(bt, 6) as busy_throughput_pct, round(bo, 6) as busy_other_pct, mean_ms from q")
def network_ratios(spark, sf):
    return _ratios(spark, sf)


@query("A16", "O4", sql=f"""with {_RATIOS}, a as (select user_id, list_filter([case when bi > 1 then 'AccountIOPS' end, case when bt > 1 then 'AccountThroughput' end, case when not (bi > 1 or bt > 1) and bi + bt + bo > 1 then 'ServerBusy' end,
  case when not (bi > 1 or bt > 1 or bi + bt + bo > 1) and ne > 2 then 'NetworkErrors' end, case when user_id % 3 = 0 then 'MbpsCapped' end,
  case when bi > 1 or bt > 1 or bi + bt + bo > 1 or ne > 2 or user_id % 3 = 0 then 'NetworkNotBottleneck' when user_id % 2 = 0 then 'SmallFilesOrNetwork' else 'ConcurrencyHitUpperLimit' end], lambda x: x is not null) as codes from q)
select user_id, cast(i - 1 as integer) as place, codes[i] as code, i = 1 as priority from a, range(1, 7) t(i) where i <= len(codes)""")
def advice(spark, sf):
    u = F.col("user_id")
    facts = _ratios(spark, sf).withColumns({
        "mbps": F.lit(95.0), "cap_mbps": F.when(u % 3 == 0, 100.0).otherwise(0.0), "concurrency_reason": F.when(u % 2 == 0, "optimum").otherwise("hit_max"),
        "cores": F.lit(8), "direction": F.lit("upload"), "to_files": F.lit(False), "bytes_per_file": F.lit(1024),
    })
    return c.advice_rows(c.advice(facts), "user_id")


@query("W2", "W3", "N9", sql="""with s as (select user_id, ts, sum(floor(value * 1000)) over (partition by user_id order by ts, event_id) as bytes from events),
g as (select *, (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 as gap, bytes - lag(bytes) over w as more from s window w as (partition by user_id order by ts))
select user_id, ts, round(case when gap > 0 then more * 8 / 1e6 / gap end, 9) as mbps from g""")
def interval_rates(spark, sf):
    e = table(spark, sf, "events")
    total = F.sum(F.floor(F.col("value") * 1000)).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return c.interval_rates(e.select("user_id", "ts", total.cast("double").alias("bytes")), "user_id").select("user_id", "ts", "mbps")


@query("A12", sql="select user_id, round(case when epoch_us(max(ts)) > epoch_us(min(ts)) then sum(value) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) else 0 end, 9) as rate from events group by user_id")
def average_rates(spark, sf):
    return c.average_rate(table(spark, sf, "events"), "user_id")


@query("A18", sql=f"with {_D} select name, case when count(*) >= 4 then round(avg(seconds), 6) else 86400.0 end as mean_seconds from f where state = 'Body' group by name")
def mean_chunk_seconds(spark, sf):
    return c.mean_chunk_seconds(c.durations(chunk_log(spark, sf)).where("state = 'Body'"), "name")


@query("W5", "O3", sql="""with l as (select l_orderkey as k, l_linenumber as n, max(l_partkey) as part from lineitem group by all), o as (select k, cast((n - 1) * 10 as bigint) as "offset", case when part % 5 = 0 then 9 else 10 end as length from l),
f as (select *, coalesce(sum(length) over (partition by k order by "offset" rows between unbounded preceding and 1 preceding), 0) = "offset" as fits from o)
select k, "offset", min(cast(fits as integer)) over (partition by k order by "offset") = 1 as ready from f""")
def contiguous_chunks(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("part"))
    rows = li.select("k", ((F.col("n") - 1) * 10).cast("long").alias("offset"), F.when(F.col("part") % 5 == 0, 9).otherwise(10).alias("length"))
    return c.contiguous(rows, "k").select("k", "offset", "ready")
