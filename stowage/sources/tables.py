"""Inventories, jobs, transfers and logs derived from the driver tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 17 == 0, "Folder").when(F.col("doc_id") % 23 == 0, "Symlink").otherwise("File")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        "doc_id",
        F.col("source").alias("container"),
        F.concat("lang", F.lit("/"), name).alias("relative_path"),
        name.alias("name"),
        kind.alias("entity_type"),
        "text",
        "n_chars",
    )


def _minutes(n: Column) -> Column:
    return F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=n.cast("int"))


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container, relative_path, name, entity_type, size, md5, last_modified, doc_id."""
    b = _base(spark, sf_dir)
    return b.select(
        "container", "relative_path", "name", "entity_type",
        F.when(F.col("entity_type") == "Folder", F.lit(0)).otherwise(F.col("n_chars")).cast("long").alias("size"),
        F.when(F.col("doc_id") % 13 != 0, F.md5("text")).alias("md5"),
        _minutes(F.col("doc_id")).alias("last_modified"),
        "doc_id",
    )


def destination_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns; a seventh is missing, hashes and times differ here and there, some rows have no source."""
    b = _base(spark, sf_dir)
    shared = b.where("doc_id % 7 <> 0").select(
        "container", "relative_path", "name", "entity_type",
        F.when(F.col("entity_type") == "Folder", F.lit(0)).otherwise(F.col("n_chars")).cast("long").alias("size"),
        F.when(F.col("doc_id") % 11 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("md5"),
        (_minutes(F.col("doc_id")) + F.make_dt_interval(days=(F.col("doc_id") % 3 - 1).cast("int"))).alias("last_modified"),
        "doc_id",
    )
    extra = b.where("doc_id % 19 = 0").select(
        "container", F.concat(F.lit("old/"), "name").alias("relative_path"), "name", F.lit("File").alias("entity_type"),
        F.col("n_chars").cast("long").alias("size"), F.md5("text").alias("md5"), F.lit(START).cast("timestamp_ntz").alias("last_modified"), "doc_id",
    )
    return shared.unionByName(extra)


SRC_SQL = """
base as (select doc_id, source as container, lang || '/' || doc_id || '.txt' as relative_path, doc_id || '.txt' as name,
    case when doc_id % 17 = 0 then 'Folder' when doc_id % 23 = 0 then 'Symlink' else 'File' end as entity_type, text, n_chars from documents),
src as (select container, relative_path, name, entity_type, case when entity_type = 'Folder' then 0 else n_chars end as size,
    case when doc_id % 13 <> 0 then md5(text) end as md5, timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute as last_modified, doc_id from base)"""
DST_SQL = """
dst as (select container, relative_path, name, entity_type, case when entity_type = 'Folder' then 0 else n_chars end as size,
    case when doc_id % 11 = 0 then md5(text || 'x') else md5(text) end as md5,
    timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute + (doc_id % 3 - 1) * interval '1' day as last_modified, doc_id from base where doc_id % 7 <> 0
  union all select container, 'old/' || name, name, 'File', n_chars, md5(text), timestamp '2024-01-01 00:00:00', doc_id from base where doc_id % 19 = 0)"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as transfers: job_id, entity_type, size, status (number), part_num, src."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    status = (
        F.when((flag == "A") & (F.col("l_linestatus") == "F"), 2)
        .when(flag == "A", 1)
        .when(flag == "N", 0)
        .when(F.col("l_linestatus") == "F", -1)
        .otherwise(-3)
    )
    kind = F.when(F.col("l_linenumber") == 1, "Folder").when(F.col("l_linenumber") == 2, "Symlink").otherwise("File")
    return li.select(
        F.col("l_orderkey").alias("job_id"), kind.alias("entity_type"), F.floor(F.col("l_extendedprice") * 1000).cast("long").alias("size"), status.alias("status"),
        F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
    )


TRANSFERS_SQL = """
transfers as (select l_orderkey as job_id, case l_linenumber when 1 then 'Folder' when 2 then 'Symlink' else 'File' end as entity_type,
    cast(floor(l_extendedprice * 1000) as bigint) as size,
    case when l_returnflag = 'A' and l_linestatus = 'F' then 2 when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 0 when l_linestatus = 'F' then -1 else -3 end as status,
    l_linenumber as line, l_shipdate as ts, l_partkey as part_key, l_suppkey as supp_key from lineitem)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("start_time"), F.col("o_orderpriority").alias("command"))


#: Which chunk state each event type stands for.
STATES = {"view": "Worker", "click": "Body", "signup": "Sorting", "purchase": "Done", "error": "BodyReRead-TooSlow"}


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return chunk_states(e)


def chunk_states(events: DataFrame) -> DataFrame:
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.col("event_type")]
    return events.select(F.col("user_id").cast("string").alias("name"), F.lit(0).cast("long").alias("offset"), state.alias("state"), "ts", "value", "event_id")


CHUNKS_SQL = """
chunks as (select cast(user_id as varchar) as name, cast(0 as bigint) as "offset", case event_type when 'view' then 'Worker' when 'click' then 'Body'
    when 'signup' then 'Sorting' when 'purchase' then 'Done' when 'error' then 'BodyReRead-TooSlow' end as state, ts, value, event_id from events)"""
