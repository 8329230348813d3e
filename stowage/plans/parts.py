"""Transfer plans cut into parts and chunks, stored, resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.functions.values import chunk_count, default_block_size
from stowage.schemas import SCHEMA_VERSION

PART_ROWS = 10_000
#: Pieces of a job that are numbered apart from each other.
PIECES = 256
#: Characters of a job's id that stored plans are parted by.
PREFIX = 2


def numbered(rows: DataFrame, keys: list[str], by: str, ties: list[str]) -> DataFrame:
    """Adds seq: 0, 1, ... within the keys, ordered by (hash of ``by``, ties).

    The order spreads names evenly, as a shuffled plan does. Rows fall into PIECES by the top bits of the hash; pieces are counted, and
    each is numbered from where those before it end, so a job with most of the rows is no single task.
    """
    hashed = rows.withColumn("h", F.xxhash64(by)).withColumn("piece", F.shiftrightunsigned("h", 64 - (PIECES - 1).bit_length()).cast("int"))
    sizes = hashed.groupBy(*keys, "piece").agg(F.count("*").alias("rows_in"))
    before = F.sum("rows_in").over(Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "piece", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys, "piece").orderBy("h", *ties))
    return hashed.withColumn("own", own).join(starts, [*keys, "piece"]).withColumn("seq", (F.col("before") + F.col("own") - 1).cast("long")).drop("own", "before", "piece", "h")


def in_parts(rows: DataFrame, by: str, ties: list[str], part_rows: int = PART_ROWS, hardlinks_last: bool = False) -> DataFrame:
    """Adds seq, part_num and is_final within each job. Hard links with a target come in later parts of their own."""
    late = (F.col("entity_type") == "Hardlink") & F.col("target_hardlink").isNotNull() if hardlinks_last else F.lit(False)
    n = numbered(rows.withColumn("part_class", late.cast("int")), ["job_id", "part_class"], by, ties)
    counts = n.groupBy("job_id", "part_class").agg((F.floor(F.max("seq") / part_rows) + 1).alias("parts"))
    early = counts.groupBy("job_id").agg(F.sum(F.when(F.col("part_class") == 0, F.col("parts")).otherwise(0)).alias("early"), F.sum("parts").alias("all_parts"))
    part = F.floor(F.col("seq") / part_rows) + F.when(F.col("part_class") == 1, F.col("early")).otherwise(0)
    return n.join(early, "job_id").withColumn("part_num", part.cast("int")).withColumn("is_final", F.col("part_num") == F.col("all_parts") - 1).drop("early", "all_parts")


def chunks(rows: DataFrame, block: Column | None = None) -> DataFrame:
    """One row a chunk: chunk, offset, length. An empty object has one empty chunk."""
    sized = rows.withColumn("block", default_block_size(F.col("size")) if block is None else block)
    n = chunk_count(F.col("size"), F.col("block"), F.col("block"))
    return (
        sized.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        .withColumn("offset", F.col("chunk") * F.col("block"))
        .withColumn("length", F.least(F.col("block"), F.col("size") - F.col("offset")))
    )


def plan_file_name(job: Column, part: Column, version: int = SCHEMA_VERSION) -> Column:
    """K5."""
    return F.format_string("%s--%05d.steV%d", job.cast("string"), part, F.lit(version))


def parsed_plan_name(name: Column) -> Column:
    pattern = r"^(.*)--(\d{5,})\.steV(\d+)$"
    return F.struct(
        F.regexp_extract(name, pattern, 1).alias("job_id"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("part_num"), F.regexp_extract(name, pattern, 3).try_cast("int").alias("schema_version")
    )


def job_prefix(job: Column) -> Column:
    """What stored plans are parted by; never empty."""
    return F.rpad(F.substring(job.cast("string"), 1, PREFIX), PREFIX, "_")


def write_plan(plan: DataFrame, path: str) -> None:
    """K4: Parquet by schema version and the job's first two characters, in files of about a part: a scan of one job opens its own folder."""
    out = plan.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "job_prefix": job_prefix(F.col("job_id"))})
    out.repartition("job_id", "part_num").write.partitionBy("schema_version", "job_prefix").mode("append").parquet(path)


def dry_run(plan: DataFrame) -> DataFrame:
    """K6: a plan's rows as JSON lines, the output in place of execution."""
    return plan.select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in plan.columns])).alias("line"))


def write_chunk_log(log: DataFrame, path: str) -> None:
    """K8."""
    log.select(F.col("name").alias("Name"), F.col("offset").alias("Offset"), F.col("state").alias("State"), F.col("ts").cast("string").alias("StateStartTime")).write.option("header", True).csv(path)


def measure(rows: DataFrame, *observed: Column) -> dict:
    """Runs a plan and throws its rows away; what was observed on the way: ``rows``, their number, and the given aggregates."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("rows"), *observed).write.format("noop").mode("overwrite").save()
    return seen.get


def history_to_delete(jobs: DataFrame, keep: list[str] | None = None, job: str | None = None) -> DataFrame:
    """Which jobs a cleaning would remove; nothing is removed here."""
    wanted = F.col("job_id").cast("string") == job if job else ~F.col("job_id").cast("string").isin(*(keep or [""]))
    return jobs.where(wanted).select("job_id", F.lit("delete").alias("action"))


def resumed(transfers: DataFrame) -> DataFrame:
    """What failed, was skipped or cancelled starts anew, with no error code; the rest stands."""
    again = F.col("status") <= -1
    return transfers.withColumns({"error_code": F.when(again, 0).otherwise(F.col("error_code")), "status": F.when(again, 5).otherwise(F.col("status"))})


def in_random_order(rows: DataFrame, seed: int) -> DataFrame:
    """A shuffled order within parts, the same for the same seed."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("job_id", "part_num").orderBy(F.xxhash64("seq", F.lit(seed)), "seq")))


def write_hashes(rows: DataFrame, path: str) -> None:
    """Hash sidecars as one table: relative_path, data (base64), mode, lmt."""
    out = rows.where(F.col("md5").isNotNull())
    out.select("relative_path", F.base64(F.unhex("md5")).alias("data"), F.lit("MD5").alias("mode"), F.col("last_modified").alias("lmt")).write.mode("append").parquet(path)


def all_zero(content: Column) -> Column:
    """Whether a page's bytes are all zero, so that it needn't be sent."""
    return F.hex(content).rlike("^0*$")
