"""Extras that object inventories don't need but analysts ask for: ranks, rollups, as-of joins, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.queries.registry import query
from stowage.sources.tables import SRC_SQL, source_inventory, table


@query("extra", sql=f"with {SRC_SQL} select container, relative_path, size, place from (select *, row_number() over (partition by container order by size desc, relative_path) as place from src) where place <= 3")
def extra_largest_objects(spark, sf):
    """A top-k report."""
    w = Window.partitionBy("container").orderBy(F.desc("size"), "relative_path")
    return source_inventory(spark, sf).withColumn("place", F.row_number().over(w)).where("place <= 3").select("container", "relative_path", "size", F.col("place").cast("long").alias("place"))


@query("extra", sql=f"with {SRC_SQL} select container, entity_type, count(*) as n, cast(sum(size) as bigint) as bytes from src group by rollup (container, entity_type)")
def extra_rollup(spark, sf):
    return source_inventory(spark, sf).rollup("container", "entity_type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("extra", sql="""with p as (select user_id, ts, event_id from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by all)
select p.event_id, coalesce(v.event_id, -1) as last_view from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def extra_as_of(spark, sf):
    """The last view at or before each purchase, by one union and one window: no range join."""
    e = table(spark, sf, "events").where("event_type in ('purchase', 'view')")
    is_view = F.col("event_type") == "view"
    w = Window.partitionBy("user_id").orderBy("ts", F.when(is_view, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("last_view", F.last(F.when(is_view, F.col("event_id")), ignorenulls=True).over(w))
    return seen.where(~is_view).select("event_id", F.coalesce("last_view", F.lit(-1)).alias("last_view"))


@query("extra", sql="""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from g) select user_id, cast(session as bigint) as session, count(*) as n, min(ts) as start, max(ts) as stop from s group by all""")
def extra_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    e = table(spark, sf, "events").withColumn("fresh", F.when(gap <= F.make_dt_interval(mins=F.lit(30)), 0).otherwise(1)).withColumn("session", F.sum("fresh").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))
