"""A destination's index that is kept between syncs, in buckets of its key, so that a later sync doesn't shuffle it again.

Each version is a bucketed table in the folder, version=N. Changes are merged by a join in which only the changes move:
a bucket of the new version comes from the same bucket of the last one. Versions are never changed in place.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.reconcile import indexed

BUCKETS = 64
KEY = ("container", "path_key")


class KeptIndex:
    """Rows of an inventory (container, relative_path, last_modified, ...), one for each key, kept in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.version: int | None = None

    def _table(self, version: int) -> str:
        return f"stowage_index_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}_{version}"

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/version={version}").saveAsTable(self._table(version))
        self.version = version

    def store(self, listing: DataFrame, ignore_case: bool = False) -> None:
        """The first version: one row a key, shuffled once into the buckets."""
        rows = indexed(listing, ignore_case).repartition(self.buckets, *KEY)
        self._write(rows, 0)

    def attach(self, version: int) -> None:
        """Takes up a version that an earlier session has written."""
        columns = self.spark.read.parquet(f"{self.folder}/version={version}").schema.simpleString().removeprefix("struct<").removesuffix(">")
        ddl = ", ".join(f"`{c.split(':', 1)[0]}` {c.split(':', 1)[1]}" for c in _split(columns))
        self.spark.sql(f"create table if not exists {self._table(version)} ({ddl}) using parquet clustered by ({', '.join(KEY)}) sorted by ({', '.join(KEY)}) into {self.buckets} buckets location '{self.folder}/version={version}'")
        self.version = version

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self._table(self.version))

    def merge(self, changes: DataFrame, ignore_case: bool = False) -> None:
        """changes: the listing's columns and ``deleted``. A changed key takes the change's row or goes; where a key changed twice the later row counts."""
        plain = [c for c in self.rows.columns if c not in KEY]
        news = indexed(changes, ignore_case).select(*KEY, F.struct(*plain).alias("n"), F.coalesce("deleted", F.lit(False)).alias("gone"))
        both = self.rows.select(*KEY, F.struct(*plain).alias("o")).join(news, list(KEY), "full_outer")
        kept = both.where(~F.coalesce("gone", F.lit(False))).select(*KEY, F.coalesce("n", "o").alias("r")).select(*KEY, "r.*")
        self._write(kept.select(*self.rows.columns), self.version + 1)


def _split(fields: str) -> list[str]:
    """A struct's fields at the top level: commas inside brackets don't part them."""
    out, depth = [""], 0
    for ch in fields:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out
