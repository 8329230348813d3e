"""Fixed schemas and enumerations. Nothing is inferred; sentinels of the raw listings become NULL at ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 21

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One object of a listing: a file, folder or link.
INVENTORY = _struct(
    container=_S, relative_path=_S, name=_S, entity_type=_S, last_modified=_TS, smb_last_modified=_TS, size=_L, md5=_S, blob_type=_S,
    content_disposition=_S, cache_control=_S, content_language=_S, content_encoding=_S, content_type=_S, access_tier=_S, archive_status=_S,
    metadata=T.MapType(_S, _S, True), tags=T.MapType(_S, _S, False), version_id=_S, snapshot_id=_S, is_deleted=T.BooleanType(),
    lease_state=_S, lease_status=_S, lease_duration=_S, target_hardlink=_S, inode=_S, dst_container=_S,
)

#: One planned copy.
TRANSFERS = _struct(
    job_id=_S, part_num=T.IntegerType(), seq=_L, source=_S, destination=_S, entity_type=_S, size=_L, last_modified=_TS, status=T.IntegerType(),
    error_code=T.IntegerType(), schema_version=T.IntegerType(),
)

#: One state change of one chunk.
CHUNK_LOG = _struct(name=_S, offset=_L, state=_S, ts=_TS)

#: Enumerations as (name, number).
ENTITY_TYPES = (("File", 0), ("Folder", 1), ("Symlink", 2), ("FileProperties", 3), ("Hardlink", 4), ("Other", 5))
TRANSFER_STATUSES = (
    ("NotStarted", 0), ("Started", 1), ("Success", 2), ("FolderCreated", 3), ("FolderExisted", 4), ("Restarted", 5), ("Failed", -1), ("BlobTierFailure", -2),
    ("SkippedEntityAlreadyExists", -3), ("SkippedBlobHasSnapshots", -4), ("TierAvailabilityCheckFailure", -5), ("Cancelled", -6),
)
JOB_STATUSES = (
    ("InProgress", 0), ("Paused", 1), ("Cancelling", 2), ("Cancelled", 3), ("Completed", 4), ("CompletedWithErrors", 5),
    ("CompletedWithSkipped", 6), ("CompletedWithErrorsAndSkipped", 7), ("Failed", 8),
)
LOCATIONS = (("Unknown", 0), ("Local", 1), ("Pipe", 2), ("Blob", 3), ("File", 4), ("BlobFS", 5), ("S3", 6), ("Benchmark", 7), ("GCP", 8), ("None", 9), ("FileNFS", 10))

DOMAINS = {"entity_type": ENTITY_TYPES, "transfer_status": TRANSFER_STATUSES, "job_status": JOB_STATUSES, "location": LOCATIONS}


def domain(spark: SparkSession, name: str) -> DataFrame:
    """code, name of one enumeration: a table of a dozen rows."""
    return spark.createDataFrame([(n, label) for label, n in DOMAINS[name]], "code int, name string")


def code_of(name: str, label: Column) -> Column:
    """A label's number, whatever its case; NULL for an unknown one."""
    pairs = [x for text, n in DOMAINS[name] for x in (F.lit(text.lower()), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), F.lower(label))


def label_of(name: str, code: Column) -> Column:
    pairs = [x for text, n in DOMAINS[name] for x in (F.lit(n), F.lit(text))]
    return F.try_element_at(F.create_map(*pairs), code)


def cleaned(raw: DataFrame) -> DataFrame:
    """P1 and the sentinel rule: empty text and the zero time become NULL, folders have size 0, columns in INVENTORY's order."""
    out = []
    for f in INVENTORY.fields:
        if f.name == "tags" and f.name in raw.columns:
            c = F.transform_values("tags", lambda k, v: F.coalesce(v.cast("string"), F.lit("")))
        else:
            c = F.col(f.name).cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
        if f.name in ("relative_path", "name"):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.when(c > F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), c)
        elif f.name == "size":
            c = F.when(F.col("entity_type") == "Folder", F.lit(0).cast("long")).otherwise(c)
        out.append(c.alias(f.name))
    return raw.select(*out)
