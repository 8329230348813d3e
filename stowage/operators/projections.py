"""Projections of inventory rows and the tallies of a listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The properties that a listing can show, by their lower-case names.
PROPERTIES = {
    "lastmodifiedtime": ("LastModifiedTime", "last_modified"),
    "versionid": ("VersionId", "version_id"),
    "blobtype": ("BlobType", "blob_type"),
    "blobaccesstier": ("BlobAccessTier", "access_tier"),
    "contenttype": ("ContentType", "content_type"),
    "contentencoding": ("ContentEncoding", "content_encoding"),
    "contentmd5": ("ContentMD5", "md5"),
    "leasestate": ("LeaseState", "lease_state"),
    "leasestatus": ("LeaseStatus", "lease_status"),
    "leaseduration": ("LeaseDuration", "lease_duration"),
    "archivestatus": ("ArchiveStatus", "archive_status"),
    "md5": ("MD5", "md5"),
    "size": ("Size", "size"),
}


def followed_by(*steps):
    """Projections in sequence, for ``DataFrame.transform``."""
    return lambda df: reduce(lambda d, f: f(d), steps, df)


def with_container(name: str):
    """P3."""
    return lambda df: df.withColumn("container", F.lit(name))


def below(prefix: str):
    """Child rows under their listed parent."""
    return lambda df: df.withColumn("relative_path", F.when(F.col("relative_path") == "", prefix).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), "relative_path")))


def name_only(path: Column) -> Column:
    """What stands after the last slash; paths without one, with one at the end or only at the start are whole."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(path.endswith("/") | (F.length(path) - F.length(last) <= 1), path).otherwise(last)


def output_path(container: Column, path: Column, kind: Column) -> Column:
    """Container, path, and a slash after folders."""
    joined = F.concat_ws("/", F.nullif(container, F.lit("")), path)
    return F.when((kind == "Folder") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    """A1: number and bytes, for each combination of the keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def listing(rows: DataFrame, properties: list[str]) -> DataFrame:
    """The output path and the chosen properties in the user's order; unknown names are ignored."""
    chosen = list(dict.fromkeys(x for x in map(str.lower, map(str.strip, properties)) if x in PROPERTIES))
    path = output_path(F.col("container"), F.col("relative_path"), F.col("entity_type")).alias("Path")
    return rows.select(path, *[F.col(PROPERTIES[x][1]).alias(PROPERTIES[x][0]) for x in chosen])


def latest_versions(rows: DataFrame) -> DataFrame:
    """A2: each path's latest version once, whatever order they are listed in. rows: relative_path, version, size."""
    return rows.groupBy("relative_path").agg(F.max("version").alias("version"), F.max_by("size", "version").alias("size"))


def to_transfers(rows: DataFrame, policy: Column) -> DataFrame:
    """P5: rows that the entity policy sends, as planned copies; folders carry no bytes."""
    return rows.where(policy).select(
        "container", F.col("relative_path").alias("source"), F.col("relative_path").alias("destination"), "entity_type",
        F.when(F.col("entity_type") == "Folder", 0).otherwise(F.col("size")).cast("long").alias("size"), "last_modified",
    )


def destination_path(path: Column, name: Column, version: Column, container: Column, dst_is_folder: bool, sub_folder: str = "", source_root: Column | None = None) -> Column:
    """Where an object goes below the destination.

    A single object (empty path) goes to the destination itself, or under its name, its version before it, into a folder;
    others keep their path, under their container, or else under the source's own folder where one is asked for.
    """
    tag = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.replace(version, F.lit(":"), F.lit("-")), F.lit("-"))).otherwise("")
    single = F.concat(F.lit("/"), tag, name) if dst_is_folder else F.lit("")
    inner = F.concat(F.lit("/"), path)
    root = F.coalesce(source_root, F.lit(False)) if source_root is not None else F.lit(False)
    inner = F.when(root, "").otherwise(inner)
    prefix = F.when(F.coalesce(container, F.lit("")) != "", F.concat(F.lit("/"), container)).otherwise(F.lit("/" + sub_folder if sub_folder else ""))
    return F.when(path == "\x00", path).when((path == "") & ~root, single).otherwise(F.concat(prefix, inner))


def overridden(rows: DataFrame, flags: Column, tier: Column, metadata: Column, tags: Column) -> DataFrame:
    """P10, B1: properties set by flag bits 1 (tier), 2 (metadata) and 4 (tags)."""
    take = lambda bit, new, old: F.when(flags.bitwiseAND(bit) != 0, new).otherwise(F.col(old))
    return rows.withColumns({"access_tier": take(1, tier, "access_tier"), "metadata": take(2, metadata, "metadata"), "tags": take(4, tags, "tags")})
