"""Queries of walks, links and folder states."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import jobs as j
from stowage.operators import projections as pr
from stowage.plans.parts import all_zero
from stowage.queries.registry import query
from stowage.sources import walk
from stowage.sources.tables import SRC_SQL, source_inventory, table


@query("Z1", sql="""select s_suppkey as link, case when s_suppkey % 10 = 5 then null else 'root' || (s_suppkey // 10) end as final from supplier""")
def link_chains(spark, sf):
    """Chains of ten suppliers lead to a root; those that end in 5 lead to themselves."""
    k = F.col("s_suppkey")
    target = F.when(k % 10 == 5, k.cast("string")).when(k % 10 == 0, F.concat(F.lit("root"), F.floor(k / 10).cast("string"))).when(k % 10 == 6, F.concat(F.lit("root"), F.floor(k / 10).cast("string"))).otherwise(F.when((k - 1) % 10 == 5, (k - 2).cast("string")).otherwise((k - 1).cast("string")))
    links = table(spark, sf, "supplier").select(k.cast("string").alias("link"), target.alias("target"))
    return walk.resolved_links(links).select(F.col("link").cast("long").alias("link"), "final")


_LEVELS = ("container", "container || '/' || lang", "container || '/' || lang || '/' || (doc_id // 100)", "container || '/' || lang || '/' || (doc_id // 100) || '/' || doc_id")


@query("S3", "S25", "F25", sql="with d as (select source as container, lang, doc_id from documents) select '' as path, 0 as level union all " + " union all ".join(f"select distinct {p} as path, {i + 1} as level from d where {p} is not null" for i, p in enumerate(_LEVELS)))
def tree_crawl(spark, sf):
    """The folders of all documents, four levels deep, and a link from every file back to its container."""
    d = table(spark, sf, "documents").select(F.col("source").alias("container"), "lang", "doc_id")
    paths = d.select(*[F.expr(p.replace("//", "div")).alias(f"p{i}") for i, p in enumerate(_LEVELS)])
    edge = lambda a, b: paths.select(a.alias("parent"), b.alias("path"))
    children = edge(F.lit(""), F.col("p0")).unionByName(edge(F.col("p0"), F.col("p1"))).unionByName(edge(F.col("p1"), F.col("p2"))).unionByName(edge(F.col("p2"), F.col("p3"))).unionByName(edge(F.col("p3"), F.col("p0")))
    return walk.crawled(children.where("path is not null").distinct(), spark.createDataFrame([("",)], "path string"))


@query("S25", "F25", sql="select o_orderkey as path, cast(o_orderkey % 1000 as integer) as level from orders where (o_orderkey // 1000) % 5 <> 4")
def deep_crawl(spark, sf):
    """Each order hangs on the one before it, in chains of a thousand from a root; every fifth chain bites its tail and is never reached."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(k, (k % 1000).alias("at"), (F.floor(k / 1000) % 5 == 4).alias("bites"))
    parent = F.when(F.col("at") > 0, k - 1).when(F.col("bites"), k + 999)
    children = orders.select(parent.cast("string").alias("parent"), k.cast("string").alias("path")).where("parent is not null")
    return walk.crawled(children, orders.where("at = 0 and not bites").select(k.cast("string").alias("path"))).select(F.col("path").cast("long").alias("path"), "level")


@query("T10", sql=f"with {SRC_SQL} select container as folder, case when max(doc_id % 3) = 2 then 'registered' when max(doc_id % 3) = 1 then 'created' else 'existed' end as state from src group by 1")
def folder_states(spark, sf):
    k = F.col("doc_id") % 3
    return j.folder_states(source_inventory(spark, sf).select(F.col("container").alias("folder"), F.when(k == 2, "registered").when(k == 1, "created").otherwise("existed").alias("state")))


@query("P2", "P3", "P4", "P10", "G3", sql=f"with {SRC_SQL} select 'box' as container, 'up/' || relative_path as relative_path, case when doc_id % 2 = 1 then 'Cool' else 'Hot' end as access_tier, case when doc_id & 4 <> 0 then 't=1' else 't=0' end as tags from src")
def projected_with_overrides(spark, sf):
    text = lambda n: F.create_map(F.lit("t"), F.lit(n))
    rows = source_inventory(spark, sf).withColumns({"access_tier": F.lit("Hot"), "metadata": text("0"), "tags": text("0")}).transform(pr.followed_by(pr.with_container("box"), pr.below("up/")))
    out = pr.overridden(rows, F.col("doc_id").cast("int"), F.lit("Cool"), text("1"), text("1"))
    return out.select("container", "relative_path", "access_tier", F.concat(F.lit("t="), F.col("tags")["t"]).alias("tags"))


@query("E7", sql="select p_partkey, p_partkey % 3 = 0 as zero from part")
def zero_pages(spark, sf):
    content = F.when(F.col("p_partkey") % 3 == 0, F.unhex(F.repeat(F.lit("00"), 64))).otherwise(F.unhex(F.concat(F.repeat(F.lit("00"), 63), F.lit("01"))))
    return table(spark, sf, "part").select("p_partkey", all_zero(content).alias("zero"))
