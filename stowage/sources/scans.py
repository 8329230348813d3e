"""Scans. Each gives rows of the inventory schema or a part of it; nothing here opens an object's content unless asked."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.operators.predicates import container_matches, exclude_values, glob_to_regex, invalid_name, is_system_container
from stowage.plans.parts import PREFIX
from stowage.session import stored
from stowage.schemas import INVENTORY, SCHEMA_VERSION, cleaned
from stowage.sources.folders import folder_listing

#: Listed paths that are looked up without a join.
SHORT_LIST = 1000
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(kind: str):
    def add(f):
        READERS[kind] = f
        return f

    return add


def open_inventory(spark: SparkSession, uri: str, kind: str | None = None, recursive: bool = True) -> DataFrame:
    """A scan by kind: table, local, benchmark, or an inventory file's format. An account (``*`` container) needs recursion."""
    kind = kind or ("benchmark" if "fc=" in uri and "nf=" in uri else uri.rsplit(".", 1)[-1] if uri.rsplit(".", 1)[-1] in READERS else "local")
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    if "*" in uri.split("://")[-1].split("/")[0] and not recursive:
        raise ValueError("a scan of several containers must be recursive")
    rows = READERS[kind](spark, uri)
    return rows if recursive else one_level(rows)


@reader("parquet")
def _parquet(spark: SparkSession, uri: str) -> DataFrame:
    return cleaned(spark.read.parquet(uri))


@reader("json")
def _json(spark: SparkSession, uri: str) -> DataFrame:
    return cleaned(spark.read.schema(INVENTORY).json(uri))


@reader("csv")
def _csv(spark: SparkSession, uri: str) -> DataFrame:
    flat = [f for f in INVENTORY.fields if f.name not in ("metadata", "tags")]
    return cleaned(spark.read.schema(type(INVENTORY)(flat)).option("header", True).csv(uri))


@reader("orc")
def _orc(spark: SparkSession, uri: str) -> DataFrame:
    return cleaned(spark.read.orc(uri))


@reader("local")
def local_files(spark: SparkSession, uri: str, with_md5: bool = False) -> DataFrame:
    """Entries below a folder, or those whose path fits a glob. Content is read only for hashes.

    The listing gives empty files too, which a content scan leaves out; their hash is that of no bytes.
    """
    root = uri if "*" not in uri else uri[: uri.index("*")].rpartition("/")[0] or "/"
    rows = folder_listing(spark, root)
    if "*" in uri:
        fits = glob_to_regex(uri[len(root.rstrip("/")) + 1 :])
        rows = rows.where(F.col("relative_path").rlike(fits)) if fits else rows.limit(0)
    if with_md5:
        base = "/" + root.strip("/") + "/"
        content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        hashes = content.select(F.substr(F.regexp_replace("path", r"^\w+:/+", "/"), F.lit(len(base) + 1)).alias("relative_path"), F.md5("content").alias("md5"))
        rows = rows.join(hashes, "relative_path", "left").withColumn("md5", F.when((F.col("size") == 0) & (F.col("entity_type") != "Folder"), F.md5(F.lit(""))).otherwise(F.col("md5")))
    return cleaned(rows)


def one_level(rows: DataFrame) -> DataFrame:
    """What isn't below a folder."""
    return rows.where(~F.col("relative_path").contains("/"))


def by_prefix(rows: DataFrame, levels: int = 1) -> DataFrame:
    """Adds the top-level prefix that a hierarchical listing is dealt out by."""
    return rows.withColumn("prefix", F.substring_index("relative_path", "/", levels))


def _common(a: Column, b: Column) -> Column:
    """Length of what two texts begin with in common."""
    least = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(0), least), lambda n: F.left(a, n) == F.left(b, n))
    return F.array_max(same)


def even_prefixes(rows: DataFrame, pieces: int) -> DataFrame:
    """Container, prefix, n, piece: prefixes that a listing is dealt out by, each path in one, in up to about ``pieces`` pieces of like size.

    A prefix that holds more than half a piece is cut one character after what its paths have in common, until none
    does (a path that is listed many times can't be cut), so no piece holds over one and a half times its share. Each
    round counts only the rows of hot prefixes. Pieces are runs of neighbouring prefixes of the histogram, which grows
    with ``pieces`` and not with the listing.
    """
    state = rows.select("container", F.coalesce("relative_path", F.lit("")).alias("path"), F.lit("").alias("prefix"))
    share = -(-state.count() // pieces) or 1
    done = []
    while True:
        counted = stored(state.groupBy("container", "prefix").agg(F.count("*").alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi")), "prefixes")
        hot = (2 * F.col("n") > share) & (F.col("lo") != F.col("hi"))
        done.append(counted.where(~hot).select("container", "prefix", "n"))
        cut = counted.where(hot).select("container", "prefix", (_common(F.col("lo"), F.col("hi")) + 1).alias("length"))
        if cut.isEmpty():
            break
        deeper = state.join(cut.withColumnRenamed("container", "c").withColumnRenamed("prefix", "p"), F.col("container").eqNullSafe(F.col("c")) & (F.col("prefix") == F.col("p")))
        state = stored(deeper.select("container", "path", F.left("path", F.col("length")).alias("prefix")), "hot-prefixes")
    histogram = reduce(DataFrame.unionByName, done)
    before = F.sum("n").over(Window.orderBy("container", "prefix").rowsBetween(Window.unboundedPreceding, -1))
    return histogram.withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / share).cast("long"))


def account(rows: DataFrame, pattern: str = "*", excluded: tuple[str, ...] = (), failed: tuple[str, ...] = ()) -> DataFrame:
    """Containers by wildcard, less the excluded ones, the service's own and those that can't be listed."""
    return rows.where(container_matches(pattern) & exclude_values((*excluded, *failed), "container") & ~is_system_container())


def versions(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the listed version ids. ids: version_id."""
    return rows.join(ids.select("version_id"), "version_id", "left_semi")


def share_scan(listing: DataFrame, properties: DataFrame, allow_trailing_dot: bool = False) -> DataFrame:
    """A listing joined with looked-up properties on container and path; names with trailing dots by policy."""
    rows = listing if allow_trailing_dot else listing.where(~invalid_name())
    return rows.join(properties, ["container", "relative_path"], "left")


def object_store_scan(rows: DataFrame, folders: bool = False) -> DataFrame:
    """Keys that end in a slash are folder marks, kept only for hierarchical stores; names the target can't hold go."""
    rows = rows if folders else rows.where(~F.col("relative_path").endswith("/"))
    return rows.where(~invalid_name() & F.coalesce(F.col("storage_class") != "", F.lit(False))) if "storage_class" in rows.columns else rows.where(~invalid_name())


def by_list(rows: DataFrame, paths: DataFrame, recursive: bool = True) -> DataFrame:
    """Rows at a listed path or below it, once for each listed path that leads to them. paths: path.

    Equality only: a row is looked up under itself and each of its ancestors, so no pair is tried in vain. A list of up
    to SHORT_LIST paths is part of the plan; a longer one is joined.
    """
    wanted = paths.select(F.rtrim("path").alias("listed")).where("listed <> ''").select(F.regexp_replace("listed", "/+$", "").alias("listed"))
    if not recursive:
        return rows.where(F.col("entity_type") != "Folder").join(wanted, rows.relative_path == wanted.listed)
    parts = F.split("relative_path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    short = [r.listed for r in wanted.limit(SHORT_LIST + 1).collect()]
    if len(short) <= SHORT_LIST and len(set(short)) == len(short):
        return rows.withColumn("listed", F.explode(F.filter(steps, lambda s: s.isin(short)))) if short else rows.withColumn("listed", F.lit("")).limit(0)
    return rows.withColumn("listed", F.explode(steps)).join(wanted, "listed")


def generated(spark: SparkSession, files: int, bytes_per_file: int, folders: int = 0) -> DataFrame:
    """Names are reversed numbers, so that they spread over any range partitioning; times are 1900-01-01."""
    number = F.col("id").cast("string")
    folder = F.concat(F.reverse((F.col("id") % max(folders, 1)).cast("string")), F.lit("/"))
    name = F.reverse(number)
    rows = spark.range(1, files + 1).select(
        (F.concat(folder, name) if folders else name).alias("relative_path"), name.alias("name"), F.lit("File").alias("entity_type"),
        F.lit(bytes_per_file).cast("long").alias("size"), F.lit("1900-01-01 00:00:00").cast("timestamp_ntz").alias("last_modified"),
    )
    return cleaned(rows)


def benchmark_to_url(files: int, bytes_per_file: int, folders: int) -> str:
    """S19."""
    return "https://benchmark.invalid?" + urlencode({"fc": files, "bpf": bytes_per_file, "nf": folders})


def benchmark_from_url(url: str) -> tuple[int, int, int]:
    q = parse_qs(url.split("?", 1)[1], strict_parsing=True)
    return int(q["fc"][0]), int(q["bpf"][0]), int(q["nf"][0])


def generated_each(workloads: DataFrame, url: str = "url") -> DataFrame:
    """The rows of every workload of a table, whose URL names files, bytes of each and folders: the table's columns, relative_path and size."""
    field = lambda name: F.parse_url(F.col(url), F.lit("QUERY"), F.lit(name)).cast("long")
    rows = workloads.withColumns({"files": field("fc"), "size": field("bpf"), "folders": field("nf")}).where("files > 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "files")))
    folder = F.when(F.col("folders") > 0, F.concat(F.reverse((F.col("i") % F.col("folders")).cast("string")), F.lit("/"))).otherwise("")
    return rows.select(*[c for c in workloads.columns if c not in ("relative_path", "size")], F.concat(folder, F.reverse(F.col("i").cast("string"))).alias("relative_path"), "size")


@reader("benchmark")
def _benchmark(spark: SparkSession, uri: str) -> DataFrame:
    return generated(spark, *benchmark_from_url(uri))


def listed_paths(lines: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One path a line, without a byte-order mark and empty lines, then the paths given besides. lines: value."""
    read = lines.select(F.regexp_replace("value", "^﻿", "").alias("path")).where("path <> ''")
    return read if more is None else read.unionByName(more.select("path"))


def listed_versions(lines: DataFrame) -> DataFrame:
    """S21."""
    return lines.select(F.trim("value").alias("version_id")).where("version_id <> ''")


def is_json_list(first: Column, second: Column) -> Column:
    """Whether a list's first two lines are those of the old format."""
    first, second = F.trim(F.coalesce(first, F.lit(""))), F.trim(second)
    return first.startswith("{") & (second.isNull() | second.startswith('"') | first.startswith('{"'))


def reject_json_list(spark: SparkSession, path: str) -> None:
    """The old list format began with a JSON object. Looks at the first two lines only."""
    first = [r.value for r in spark.read.text(path).limit(2).collect()] + [None, None]
    if spark.range(1).select(is_json_list(F.lit(first[0]), F.lit(first[1]))).first()[0]:
        raise ValueError("the list is in the old JSON format; give one path a line")


def hash_sidecar(raw: DataFrame) -> DataFrame:
    """relative_path, hash (hex), mode, hash_lmt from base64 sidecar records."""
    return raw.select("relative_path", F.lower(F.hex(F.unbase64("data"))).alias("hash"), "mode", F.col("lmt").cast("timestamp_ntz").alias("hash_lmt"))


def common_metadata(metadata: Column, prefix: str) -> Column:
    """A foreign store's metadata without its header prefix, NULL values and empty keys."""
    cut = F.transform_keys(metadata, lambda k, v: F.regexp_replace(F.lower(k), f"^{prefix}", ""))
    return F.map_filter(cut, lambda k, v: v.isNotNull() & (k != ""))


def plan_scan(plans: DataFrame, job_prefix: str = "", version: int | None = None) -> DataFrame:
    """Stored job parts by job and schema version. Order is the caller's: (job_id, part_num) are columns.

    Where the plans are parted by the job's first characters, only the folders of the prefix are opened.
    """
    wanted = F.col("job_id").cast("string").startswith(job_prefix) & (F.col("schema_version") == (version or SCHEMA_VERSION))
    if "job_prefix" in plans.columns and len(job_prefix) >= PREFIX:
        wanted &= F.col("job_prefix") == job_prefix[:PREFIX]
    return plans.where(wanted).drop("job_prefix")
