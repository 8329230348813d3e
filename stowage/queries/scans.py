"""Queries of the scans and the tallies over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import projections as pr
from stowage.operators.reconcile import with_stored_hash
from stowage.queries.registry import query
from stowage.sources import scans
from stowage.sources.tables import SRC_SQL, source_inventory, table


@query("S7", "P1", "A1", sql=f"with {SRC_SQL} select container, count(*) as n, cast(sum(size) as bigint) as bytes from src group by container")
def inventory_tally(spark, sf):
    return pr.tally(source_inventory(spark, sf), "container")


@query("S7", "S5", sql="select name, cast(count(*) as bigint) as n from (select case when doc_id % 4 = 0 then 'top' else 'deep' end as name, case when doc_id % 4 = 0 then cast(doc_id as varchar) else lang || '/' || doc_id end as p from documents) where not contains(p, '/') group by name")
def scan_one_level(spark, sf):
    flat = F.col("doc_id") % 4 == 0
    rows = table(spark, sf, "documents").select(F.when(flat, "top").otherwise("deep").alias("name"), F.when(flat, F.col("doc_id").cast("string")).otherwise(F.concat_ws("/", "lang", F.col("doc_id").cast("string"))).alias("relative_path"))
    return scans.one_level(rows).groupBy("name").agg(F.count("*").alias("n"))


@query("S6", sql=f"with {SRC_SQL} select container, split_part(relative_path, '/', 1) as prefix, count(*) as n from src group by all")
def scan_by_prefix(spark, sf):
    return scans.by_prefix(source_inventory(spark, sf)).groupBy("container", "prefix").agg(F.count("*").alias("n"))


@query("S6", sql="select if(l_returnflag = 'N', 'cold', 'hot') as container, count(*) as n, true as even from lineitem group by 1")
def scan_even_prefixes(spark, sf):
    """The lines as objects, most below one prefix, dealt out to 40 pieces; the largest is under twice the mean."""
    li = table(spark, sf, "lineitem")
    path = F.concat_ws("/", F.lit("all/of/them"), F.when(F.col("l_linenumber") < 6, "main").otherwise("side"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = li.select(F.when(F.col("l_returnflag") == "N", "cold").otherwise("hot").alias("container"), path.alias("relative_path"))
    pieces = scans.even_prefixes(rows, 40)
    largest, mean = pieces.groupBy("piece").agg(F.sum("n").alias("n")).agg(F.max("n"), F.avg("n")).first()
    return pieces.groupBy("container").agg(F.sum("n").alias("n")).withColumn("even", F.lit(largest < 2 * mean))


@query("S8", "S11", "S14", "S16", "U1", sql=f"with {SRC_SQL} select container, count(*) as n from src where regexp_matches(container, '^src[^/]$') and container not in ('src3', 'src5') group by container")
def scan_account(spark, sf):
    return scans.account(source_inventory(spark, sf), "src?", ("src3",), ("src5",)).groupBy("container").agg(F.count("*").alias("n"))


@query("S9", "S21", "D4", sql="select doc_id, strftime(timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute, '%Y-%m-%dT%H:%M:%S') as version_id from documents where doc_id % 5 = 0")
def scan_versions(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int")), "yyyy-MM-dd'T'HH:mm:ss").alias("version_id"))
    ids = scans.listed_versions(rows.where("doc_id % 5 = 0").select(F.concat(F.lit(" "), "version_id").alias("value")))
    return scans.versions(rows, ids).select("doc_id", "version_id")


@query("S10", "J15", "P11", sql=f"with {SRC_SQL} select s.container, s.relative_path, p.tier from src s left join (select container, relative_path, case when doc_id % 2 = 0 then 'Hot' else 'Cool' end as tier from src where doc_id % 3 <> 0) p using (container, relative_path)")
def scan_with_properties(spark, sf):
    rows = source_inventory(spark, sf)
    props = rows.where("doc_id % 3 <> 0").select("container", "relative_path", F.when(F.col("doc_id") % 2 == 0, "Hot").otherwise("Cool").alias("tier"))
    return scans.share_scan(rows.select("container", "relative_path"), props)


@query("S12", "S13", "S15", sql="select page_id, url as relative_path from pages where not ends_with(url, '/') and not (ends_with(url, '.') or contains(url, './')) and page_id % 5 <> 0")
def scan_object_store(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.col("url").alias("relative_path"), F.when(F.col("page_id") % 5 != 0, "STANDARD").otherwise("").alias("storage_class"))
    return scans.object_store_scan(rows).select("page_id", "relative_path")


@query("S17", "J13", "S20", "U2", sql=f"with {SRC_SQL}, l(listed) as (values ('en'), ('fr/3.txt'), ('es/no.txt'), ('de/8.txt'), ('de')) select l.listed, s.container, s.relative_path from src s join l on s.relative_path = l.listed or starts_with(s.relative_path, l.listed || '/')")
def scan_by_list(spark, sf):
    lines = spark.createDataFrame([("﻿en/",), ("",), ("fr/3.txt",), ("es/no.txt",)], "value string")
    more = spark.createDataFrame([("de/8.txt",), ("de",)], "path string")
    rows = scans.by_list(source_inventory(spark, sf), scans.listed_paths(lines, more))
    return rows.select("listed", "container", "relative_path")


@query("S17", "S20", "J13", sql=f"with {SRC_SQL}, l(listed) as (select relative_path from src where doc_id % 3 = 0 union select distinct split_part(relative_path, '/', 1) from src where starts_with(relative_path, 'e')) select l.listed, s.container, s.relative_path from src s join l on s.relative_path = l.listed or split_part(s.relative_path, '/', 1) = l.listed")
def scan_by_long_list(spark, sf):
    """The list grows with the table: a third of all files and the folders that begin with e. Beyond a thousand paths it is joined."""
    rows = source_inventory(spark, sf)
    lines = rows.where("doc_id % 3 = 0").select(F.col("relative_path").alias("value"))
    folders = rows.where(F.col("relative_path").startswith("e")).select(F.concat(F.substring_index("relative_path", "/", 1), F.lit("/")).alias("path")).distinct()
    return scans.by_list(rows, scans.listed_paths(lines, folders)).select("listed", "container", "relative_path")


@query("S18", "S19", "O6", "S1", sql="select reverse(cast(i % 7 as varchar)) || '/' || reverse(cast(i as varchar)) as relative_path, cast(1024 as bigint) as size from range(1, 501) t(i)")
def scan_generated(spark, sf):
    return scans.open_inventory(spark, scans.benchmark_to_url(500, 1024, 7)).select("relative_path", "size")


@query("S1", "S18", "S19", "O6", sql="select p_partkey, case when p_partkey % 3 > 0 then reverse(cast(i % (p_partkey % 3) as varchar)) || '/' else '' end || reverse(cast(i as varchar)) as relative_path, cast(p_partkey * 10 as bigint) as size from part, range(1, 42) t(i) where i <= p_partkey % 41")
def scan_generated_from_parts(spark, sf):
    """A workload for each part, by its URL: up to forty files, their size, up to two folders."""
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://benchmark.invalid?bpf="), (k * 10).cast("string"), F.lit("&fc="), (k % 41).cast("string"), F.lit("&nf="), (k % 3).cast("string"))
    return scans.generated_each(table(spark, sf, "part").select("p_partkey", url.alias("url"))).drop("url")


@query("S23", "O2", sql="select l_orderkey as job_id, cast(l_linenumber - 1 as integer) as part_num, count(*) as n from lineitem where starts_with(cast(l_orderkey as varchar), '12') and l_linenumber % 2 = 1 group by all")
def scan_plans(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).cast("int").alias("part_num"), F.when(F.col("l_linenumber") % 2 == 1, 21).otherwise(20).alias("schema_version"))
    return scans.plan_scan(rows, "12").groupBy("job_id", "part_num").agg(F.count("*").alias("n"))


@query("S27", "J12", "Z5", "X1", sql=f"with {SRC_SQL} select container, relative_path, case when doc_id % 4 = 0 then md5(text) || '-stored' else md5(text) end as md5 from src join (select doc_id, text from documents) using (doc_id)")
def scan_with_hashes(spark, sf):
    """A stored hash is used where its mode and time fit the file; the others are computed."""
    rows = source_inventory(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    sidecar = rows.where("doc_id % 2 = 0").select(
        "container", "relative_path", F.concat(F.md5("text"), F.lit("-stored")).alias("hash"), F.lit("MD5").alias("mode"),
        (F.col("last_modified") + F.when(F.col("doc_id") % 4 == 0, F.make_dt_interval()).otherwise(F.make_dt_interval(secs=F.lit(1)))).alias("hash_lmt"),
    )
    return with_stored_hash(rows, sidecar, F.md5("text")).select("container", "relative_path", "md5")


@query("S28", "M4", sql="select part_key, 'brand' as k, brand as v from (select p_partkey as part_key, p_brand as brand from part)")
def scan_foreign_metadata(spark, sf):
    m = F.create_map(F.lit("X-Amz-Meta-Brand"), F.col("p_brand"), F.lit("x-amz-meta-none"), F.lit(None).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part_key"), F.explode(scans.common_metadata(m, "x-amz-meta-")).alias("k", "v"))


@query("P6", "K7", "P8", sql=f"with {SRC_SQL} select container || '/' || relative_path || case when entity_type = 'Folder' then '/' else '' end as \"Path\", md5 as \"MD5\", size as \"Size\" from src")
def list_properties(spark, sf):
    return pr.listing(source_inventory(spark, sf), ["md5", "nonsense", "SIZE"])


@query("A2", sql="select lang || '/' || (doc_id % 50) as relative_path, max(doc_id) as version, arg_max(n_chars, doc_id) as size from documents group by 1")
def list_latest_version(spark, sf):
    rows = table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("relative_path"), F.col("doc_id").alias("version"), F.col("n_chars").alias("size"))
    return pr.latest_versions(rows)
