"""Exact deduplication with counting quotient filters.

A text's fingerprint is 64 bits: the quotient names a slot, the remainder is what the slot stores. Each partition
builds its own filter; filters with the same quotient range merge without loss by merging their sorted remainders and
adding counters. A count of one proves a text unique. Rows whose fingerprint counts more than one go to byte
verification, where the normalised texts themselves are the grouping key. A filter is stored as the run lengths of its
occupied quotients and the runs' sorted remainders with counters: the table without its empty slots, as a filter that is
only built, merged and scanned needs none of the metadata bits that find a slot.

Defined results: a null text counts as empty; empty texts equal each other; a null doc_id loses against any other;
rows that share doc_id, length and normalised text share one verdict; an empty table gives no rows; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import SPACE, small_batches, staged

QUOTIENT_BITS = 20
REMAINDER_BITS = 64 - QUOTIENT_BITS
SALTS = 32
_MASK = np.uint64((1 << REMAINDER_BITS) - 1)


def normalised(text: Column) -> Column:
    """The text without the six white space characters."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACE, F.coalesce(text, F.lit("")))


class CountingQuotientFilter:
    """Occupied quotients, the length of each one's run, and in each run sorted remainders with their counters."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        prints = np.asarray(fingerprints).astype(np.int64, copy=False).view(np.uint64)
        keys, place = np.unique(prints, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)
        quotients, runs = np.unique((keys >> np.uint64(REMAINDER_BITS)).astype(np.uint32), return_counts=True)
        return cls(quotients, runs.astype(np.uint32), keys & _MASK, total)

    def fingerprints(self) -> np.ndarray:
        high = np.repeat(self.quotients.astype(np.uint64), self.runs)
        return ((high << np.uint64(REMAINDER_BITS)) | self.remainders).view(np.int64)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All are sorted by (quotient, remainder), so equal remainders meet and their counters add. Nothing is lost."""
        return cls.of(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def to_bytes(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.quotients.tobytes(), self.runs.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def from_bytes(cls, q: bytes, n: bytes, r: bytes, c: bytes) -> CountingQuotientFilter:
        return cls(np.frombuffer(q, np.uint32), np.frombuffer(n, np.uint32), np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64))


def partition_filters(slices: int):
    """Builds this partition's filter and deals it out by slices of the quotient range."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for batch in batches:
            new = CountingQuotientFilter.of(batch["fp"].to_numpy())
            own = new if own is None else CountingQuotientFilter.merged([own, new])
        if own is None or not len(own.remainders):
            return
        prints = own.fingerprints()
        slot = (prints.view(np.uint64) >> np.uint64(REMAINDER_BITS)).astype(np.int64) * slices >> QUOTIENT_BITS
        rows = []
        for s in np.unique(slot):
            at = slot == s
            rows.append((int(s), *CountingQuotientFilter.of(prints[at], own.counts[at]).to_bytes()))
        yield pd.DataFrame(rows, columns=["slice", "q", "n", "r", "c"])

    return build


def merge_slice(rows: pd.DataFrame) -> pd.DataFrame:
    """The fingerprints of one slice that count more than one over all partitions."""
    merged = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(*x) for x in rows[["q", "n", "r", "c"]].itertuples(index=False)])
    many = merged.counts > 1
    return pd.DataFrame({"fp": merged.fingerprints()[many], "n_fp": merged.counts[many]})


def exact_dedup(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. Keeps the longest original, then the smallest doc_id.

    slices: pieces of the quotient range that merge apart from each other; grows with the shuffle partitions.
    """
    spark = small_batches(docs, 10_000)
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("norm", normalised(F.col("text")))
    light = rows.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"))
    repeated = (
        rows.select(F.xxhash64("norm").alias("fp"))
        .mapInPandas(partition_filters(slices), "slice int, q binary, n binary, r binary, c binary")
        .groupBy("slice")
        .applyInPandas(merge_slice, "fp long, n_fp long")
    )
    # Copies of one text are dealt over SALTS tasks and counted there, so a hot text is one row of each by the time it is grouped.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    wanted = repeated.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    verified = (
        rows.select("doc_id", "norm", F.xxhash64("norm").alias("fp"), F.char_length("text").alias("n"), salt.alias("salt"))
        .join(wanted.hint("merge"), ["fp", "salt"], "left_semi")
        .groupBy("fp", "norm", "n")
        .agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"))
        .select("fp", F.sha2("norm", 256).alias("text_sha256"), "n", "rows", "first_id")
    )
    has_id = F.col("first_id").isNotNull()
    classes = (
        verified.groupBy("fp", "text_sha256")
        .agg(F.sum("rows").alias("group_size"), F.max(F.struct("n", has_id.alias("has_id"), F.bitwise_not("first_id").alias("low"))).alias("best"))
        .select("fp", "text_sha256", "group_size", F.bitwise_not("best.low").alias("class_keep"))
    )
    classes = staged(classes, "exact-classes")  # written, so the join is of two plain shuffles and a hot class can be split
    return light.join(classes.hint("merge"), ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("class_keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("class_keep"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of rows that share doc_id, length and normalised text one stays."""
    verdict = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    sha, length = F.sha2(normalised(F.col("text")), 256), F.char_length(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", sha.alias("sha"), length.alias("n"))
    stay = rows.join(verdict, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")))
    longest = stay.groupBy("doc_id", "sha").agg(F.max_by("row", F.struct("n", "row.text")).alias("row"))  # needs no order of other columns
    return longest.select("row.*")
