"""Filters of a fixed number of bits over a column of longs. A false positive costs work, never a wrong row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import reachable

PARTS = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bitmap:
    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(8 * len(bits))

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may be among those the filter was built of."""
        slot = mixed(keys.view(np.uint64)) % self.size
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def build(keys: DataFrame, log2_bits: int) -> Bitmap:
    """keys: one long column. The driver gets 2**log2_bits bits, whatever the number of keys."""
    reachable(keys.sparkSession)
    size, per = np.uint64(1 << log2_bits), (1 << log2_bits) // PARTS

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = np.unique((mixed(batch.iloc[:, 0].to_numpy(np.int64).view(np.uint64)) % size).astype(np.int64))
            yield pd.DataFrame({"part": slot // per, "at": slot % per})

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(per, bool)
        flags[rows["at"].to_numpy()] = True
        return pd.DataFrame({"part": rows["part"].iloc[:1].to_numpy(), "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    bits = np.zeros((PARTS, per // 8), np.uint8)
    parts = keys.mapInPandas(slots, "part long, at long").distinct().groupBy("part").applyInPandas(fill, "part long, bits binary")
    for r in parts.collect():
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return Bitmap(bits.ravel())


def maybe_in(bitmap: Bitmap, df: DataFrame):
    """A column function: long -> may be in the filter; null never is."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap.bits)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        return pd.Series(Bitmap(shared.value).has(keys.fillna(0).to_numpy(np.int64)) & known)

    return test
