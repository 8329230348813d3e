"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import reachable, shared_folder

#: ASCII white space as the operators' contracts define it: space and \\x09-\\x0D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(df: DataFrame, rows: int = 1000) -> SparkSession:
    """Bounds what a Python worker holds of whole texts at a time: batches of at most ``rows`` rows.

    The setting is the session's and stays, since Spark reads it when the result is computed, which the caller does later.
    """
    spark, key = reachable(df.sparkSession), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    return spark


#: Folders that scratch_of has open, innermost last; applications whose folder goes when the driver's Python ends.
_open: list[str] = []
_ending: set[str] = set()


def _application(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stowage-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet in the shared folder and reads them back.

    rows_a_file: for rows of many MB, as readers take up to thousands of rows of one file at once.

    What is read back survives the loss of any executor, and later stages don't repeat the work above. The rows stay
    until ``release``, the end of the ``scratch_of`` they were written in, or the end of the driver's Python.
    """
    spark = df.sparkSession
    if (own := _application(spark)) not in _ending:
        _ending.add(own)
        atexit.register(_remove, spark, own)
    path = f"{_open[-1] if _open else own}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned inside removes its shuffle files when it ends, not when the driver's garbage is next collected: the rows that they led to are stored by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def scratch_of(spark: SparkSession, name: str) -> Iterator[None]:
    """What is staged inside is removed at its end: by then the result must have been stored elsewhere."""
    folder = f"{_application(spark)}/{name}-{uuid.uuid4().hex}"
    _open.append(folder)
    try:
        yield
    finally:
        _open.remove(folder)
        _remove(spark, folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``staged``, outside of any ``scratch_of``."""
    inside, _open[:] = _open[:], []
    try:
        return staged(df, name)
    finally:
        _open[:] = inside


def kept(df: DataFrame, name: str) -> DataFrame:
    """Like ``staged``, outside of the innermost ``scratch_of``."""
    inner = _open.pop()
    try:
        return staged(df, name)
    finally:
        _open.append(inner)


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Removes what this application's operators have written for themselves. Call it once their results are stored."""
    _remove(spark, _application(spark))
