"""Removal of repeated byte strings by externally sorted, induced suffix tuples.

A string of LENGTH bytes is removed where it also starts anywhere else. The suffixes are not all sorted: as in induced
sorting, a sparse set of them is sorted, and the order of all others follows from theirs.

* Sampled suffixes. A position is sampled if the KEY-byte string there is the least, by hash, of some LENGTH-byte
  window, leftmost on ties. That depends on the window's bytes alone, so equal windows have equal samples at equal
  distances, and every window has one: one in about 100 positions is sampled.
* Tuples. A sampled suffix's tuple is (name of its first KEY bytes, name of its run: all windows that it is the sample
  of). Spark's external sorter is the disk-backed priority queue: tuples are spilled as sorted runs and merged by
  name, so a shard may be far larger than memory, and map-side counting folds a hot name before it moves.
* Induction. Tuples with equal names share at least KEY bytes. Where whole runs are equal, all their windows are
  repeats. Otherwise the windows of one run of
  each name, in blocks of BLOCK distances, refine the order: a block's name is its common
  core, LENGTH - BLOCK + 1 bytes; of blocks with equal cores the common prefix is carried on, and the at most
  BLOCK - 1 bytes to the left and right settle window by window which of them reach LENGTH. Only documents that hold
  such a run are read again.

The same sampling over words in place of bytes finds passages: PASSAGE words in a row, white space aside, that also
stand in another document. They are reported and stay in the text.

Names are 128 bits of two polynomial hashes of the bytes they stand for, in place of ranks: equality, which is all that
removal needs, is kept, and no rank has to be agreed on by all machines. Filters of a fixed number of bits only save
work: what they let through is counted, and a full one lets through one tuple for each sampled suffix.

Defined results: a null text is empty; strings never cross documents, the same document included otherwise; rows
repeated with the same doc_id count as documents of their own for bytes, as one for passages; texts under LENGTH bytes are kept whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.bitmap import Bitmap, build, maybe_in, mixed
from stowage.llm.common import small_batches, staged

LENGTH, KEY, BLOCK = 400, 200, 16
CORE = LENGTH - BLOCK + 1
#: Words of a passage, and of the strings of it that are sampled.
PASSAGE, PASSAGE_KEY = 51, 20
#: Documents are worked through in stretches of this many windows, so memory doesn't follow a document's length.
STRETCH = 1 << 21
#: Texts up to this many bytes are worked through several at a time, about as many bytes together.
TOGETHER = 1 << 16
BITMAP_LOG2 = 27
_SPANS = "array<long>"
#: The two hashes' bases and the multipliers that spread the codes of bytes; codes over 255 are first bytes of words.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CODES = tuple(mixed(np.arange(1, 513, dtype=np.uint64) * np.uint64(m)) for m in (0xD1B54A32D192ED03, 0xA24BAED4963EE407))
#: Keeps the keys of words apart from those of bytes.
_WORD_KEYS = np.int64(0x5851F42D4C957F2D)


@cache
def _powers(log2: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    up = np.full(1 << log2, _BASES[which], np.uint64)
    down = np.full(1 << log2, pow(_BASES[which], -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Two hashes of any substrings of one stretch of codes, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.sums = codes, [None, None]

    def _sums(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers(max(12, int(len(self.codes)).bit_length()), which)
        if self.sums[which] is None:
            self.sums[which] = np.zeros(len(self.codes) + 1, np.uint64)
            np.cumsum(_CODES[which][self.codes] * up[: len(self.codes)], out=self.sums[which][1:])
        return self.sums[which], down

    def of(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        sums, down = self._sums(which)
        return (sums[stop] - sums[start]) * down[start]

    def all_of(self, length: int) -> np.ndarray:
        """Of every substring of one length."""
        sums, down = self._sums(0)
        n = len(sums) - length
        return (sums[length:] - sums[:n]) * down[:n]

    def names(self, start: np.ndarray, stop: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each substring and a number that goes with it."""
        return tuple(mixed(self.of(start, stop, which) + mixed(shape.astype(np.uint64) + np.uint64(7 + which))).view(np.int64) for which in (0, 1))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: of 2, 4, 8 ... neighbours, then of two such groups that overlap."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    n = max(0, len(values) - width + have)
    return np.minimum(values[:n], values[width - have :])


class Segments:
    """What a stretch of units holds of which rows: segment i is of row ``rows[i]`` from unit ``offsets[i]`` on, in [starts[i], stops[i])."""

    def __init__(self, rows: list[int], offsets: list[int], starts: np.ndarray, stops: np.ndarray):
        self.rows, self.offsets, self.starts, self.stops = np.array(rows), np.array(offsets), np.asarray(starts), np.asarray(stops)

    def within(self, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of first..last, fewer than ``length`` windows each, those within one segment; none if first is greater. More than that many cross from one segment to another, so none lie in two."""
        i = np.searchsorted(self.starts, last, side="right") - 1
        return np.maximum(first, self.starts[i]), np.minimum(last, self.stops[i] - length)

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place in the row's text of each unit."""
        i = np.searchsorted(self.starts, units, side="right") - 1
        return self.rows[i], units - self.starts[i] + self.offsets[i]


class Runs:
    """The sampled suffixes of a stretch and the windows of each: first..last (inclusive), sample at ``at``; row and start of each one's first window.

    bounds: where each unit of the codes begins, and the end; None where every code is a unit.
    """

    def __init__(self, codes: np.ndarray, segments: Segments, bounds: np.ndarray | None = None):
        self.hasher, self.bounds = Hasher(codes), bounds
        self.length, key = (LENGTH, KEY) if bounds is None else (PASSAGE, PASSAGE_KEY)
        keys = self.hasher.all_of(key) if bounds is None else self.hasher.of(bounds[:-key], bounds[key:])
        place = np.uint64((1 << 22) - 1)
        least = _sliding_min((keys & ~place) | np.arange(len(keys), dtype=np.uint64), self.length - key + 1)
        cuts = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
        first, last = segments.within(cuts, np.r_[cuts[1:] - 1, len(least) - 1], self.length)
        some = first <= last
        self.first, self.last = first[some], last[some]
        self.at = (least[self.first] & place).astype(np.int64)
        self.key = mixed(keys[self.at]).view(np.int64) ^ (0 if bounds is None else _WORD_KEYS)
        self.row, self.start = segments.of(self.first)

    def names(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last, at = self.first[pick], self.last[pick], self.at[pick]
        stop = last + self.length
        start, stop = (first, stop) if self.bounds is None else (self.bounds[first], self.bounds[stop])
        return self.hasher.names(start, stop, (at - first) * (1 << 20) + last - first)


def _stretches(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes): stretches overlap by LENGTH - 1 bytes, so each window lies in exactly one."""
    raw = _raw(text)
    for lo in range(0, max(0, len(raw) - LENGTH + 1), STRETCH):
        yield lo, raw[lo : lo + STRETCH + LENGTH - 1]


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _words(raw: np.ndarray, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins in the bytes, the end after them, and which bytes are white space. texts: where texts begin, with nothing between them."""
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    begins = ~space
    begins[1:] &= space[:-1]
    if texts is not None:
        own = texts[texts < len(raw)]
        begins[own] = ~space[own]
    return np.r_[np.flatnonzero(begins), len(raw)], space


def _coded(raw: np.ndarray, starts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the bytes from the first word to the last bound, without white space, and the words' bounds in them."""
    lo, hi = starts[0], starts[-1]
    codes = raw[lo:hi].astype(np.uint16)
    codes[starts[:-1] - lo] += 256
    solid = ~space[lo:hi]
    before = np.zeros(len(solid) + 1, np.int64)
    np.cumsum(solid, out=before[1:])
    return codes[solid], before[starts - lo]


def _word_stretches(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, codes, bounds): stretches overlap by PASSAGE - 1 words."""
    starts, space = _words(raw)
    n = len(starts) - 1
    step = max(1, STRETCH // 8)
    for lo in range(0, max(0, n - PASSAGE + 1), step):
        yield lo, *_coded(raw, starts[lo : min(n, lo + step + PASSAGE - 1) + 1], space)


def _one(row: int, offset: int, units: int) -> Segments:
    return Segments([row], [offset], [0], [units])


def _together(rows: list[int], raws: list[bytes]) -> Iterator[tuple[int, Runs]]:
    """Short texts in one stretch, line breaks between them."""
    raw = np.frombuffer(b"\n".join(raws), np.uint8)
    lengths = np.array([len(x) for x in raws])
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    if len(raw) >= LENGTH:
        yield 0, Runs(raw, Segments(rows, [0] * len(rows), starts, starts + lengths))
    words, space = _words(raw)
    if len(words) > PASSAGE:
        first = np.searchsorted(words[:-1], np.r_[starts, len(raw) + 1])  # each text's first word
        yield 1, Runs(*_with(_coded(raw, words, space), Segments(rows, [0] * len(rows), first[:-1], first[1:])))


def _with(coded: tuple[np.ndarray, np.ndarray], segments: Segments) -> tuple:
    return coded[0], segments, coded[1]


def _all_runs(texts: pd.Series) -> Iterator[tuple[int, Runs]]:
    """(kind, runs): kind 0 in bytes, 1 in words."""
    rows, raws, size = [], [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > TOGETHER:
            for lo, data in _stretches(text):
                yield 0, Runs(data, _one(row, lo, len(data)))
            for lo, codes, bounds in _word_stretches(_raw(text)):
                yield 1, Runs(codes, _one(row, lo, len(bounds) - 1), bounds)
            continue
        rows.append(row)
        raws.append(raw)
        size += len(raw)
        if size > TOGETHER:
            yield from _together(rows, raws)
            rows, raws, size = [], [], 0
    if rows:
        yield from _together(rows, raws)


def _sampled_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = [r.key for _, r in _all_runs(batch["text"])]
        if keys:
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pd.DataFrame({"key": found, "n": n})


_TUPLES = "kind int, doc_id long, mark long, start long, place int, n int, key long, run long, run2 long"


def _tuples(repeated):
    """Second pass: the sampled suffixes that may have a repeated key. place: the sample's distance from its run's first window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = Bitmap(repeated.value)
        for batch in batches:
            found = []
            for kind, r in _all_runs(batch["text"]):
                pick = np.flatnonzero(filter_.has(r.key))
                if len(pick):
                    found.append((r.row[pick], np.full(len(pick), kind), r.start[pick], r.at[pick] - r.first[pick], r.last[pick] - r.first[pick] + 1, r.key[pick], *r.names(pick)))
            if found:
                row, kind, start, place, n, key, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                frame = pd.DataFrame({"kind": kind, "start": start, "place": place, "n": n, "key": key, "run": a, "run2": b})
                frame.insert(1, "doc_id", batch["doc_id"].astype("Int64").take(row).array)
                frame.insert(2, "mark", batch["mark"].to_numpy()[row])
                yield frame

    return run


_REFINED = "kind int, doc_id long, mark long, start long, name long, name2 long, left binary, right binary, run long, run2 long, low long, high long"
_ARROW = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in map(str.split, _REFINED.split(", "))])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third pass, over documents with chosen runs: their blocks (kind 0) and their windows of words (kind 1), to be settled."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch["text"].cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        picks = {f: batch[f].flatten().to_numpy().astype(np.int64) for f in ("kind", "start", "place", "n", "run", "run2", "low", "high")}
        picks["row"] = np.repeat(np.arange(len(texts)), pc.list_value_length(batch["kind"]).to_numpy())
        for own in _parts(_of(picks, picks["kind"] == 0), ends, TOGETHER):
            yield _blocks(raw, ends, batch, own)
        passages = _of(picks, picks["kind"] == 1)
        of_row = np.searchsorted(passages["row"], np.arange(len(ends)))
        for lo, hi in _neighbours(ends):
            some = _of(passages, slice(of_row[lo], of_row[hi]))
            if len(some["row"]):
                yield from _passages(raw[ends[lo] : ends[hi]], ends[lo:hi] - ends[lo], lo, some)


def _of(picks: dict[str, np.ndarray], which: np.ndarray | slice) -> dict[str, np.ndarray]:
    return {f: x[which] for f, x in picks.items()}


def _parts(picks: dict[str, np.ndarray], texts: np.ndarray, width: int) -> Iterator[dict[str, np.ndarray]]:
    """The picks in order of ``begin``, where each one's run begins among the units of all texts, ``width`` units at a time. texts: where each row's text begins."""
    begin = texts[picks["row"]] + picks["start"]
    order = np.argsort(begin, kind="stable")
    begin = begin[order]
    for own in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // width)) + 1):
        if len(own):
            yield _of(picks, order[own]) | {"begin": begin[own]}


def _neighbours(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows that are worked through together: TOGETHER bytes, or one longer text."""
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + TOGETHER, side="right")) - 1)
        yield lo, hi
        lo = hi


def _ramps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number as often as its count says, and 0, 1, 2 ... along each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    which, along = _ramps(stop - start)
    offsets = np.r_[0, np.cumsum(stop - start)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[start[which] + along])])


def _blocks(raw: np.ndarray, ends: np.ndarray, batch: pa.RecordBatch, picks: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The blocks of neighbouring runs. Their cores lie within the run: from its first byte to the last one of its last window."""
    low = (picks["place"] - picks["n"] + 1) // BLOCK
    which, along = _ramps(picks["place"] // BLOCK - low + 1)
    b = low[which] + along
    core = (picks["begin"] + picks["place"])[which] - BLOCK * b
    base, row = int(picks["begin"][0]), picks["row"][which]
    codes = raw[base : int(core.max()) + CORE]
    name, name2 = Hasher(codes).names(core - base, core - base + CORE, b + (1 << 40))
    left = _slices(raw, np.maximum(core - BLOCK + 1, ends[row]), core)
    right = _slices(raw, core + CORE, np.minimum(core + CORE + BLOCK - 1, ends[row + 1]))
    return _record(0, len(core), doc_id=batch["doc_id"].take(pa.array(row)), mark=batch["mark"].take(pa.array(row)), start=core - ends[row], name=name, name2=name2, left=left, right=right)


def _passages(raw: np.ndarray, texts: np.ndarray, row: int, picks: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The windows of words of the runs of texts that stand one after another. texts: where each begins, row: the first one's."""
    words, space = _words(raw, texts)
    firsts = np.searchsorted(words[:-1], texts)
    for own in _parts(picks | {"row": picks["row"] - row}, firsts, TOGETHER // 8):
        which, along = _ramps(own["n"])
        first = int(own["begin"][0])
        at = own["begin"][which] + along - first
        codes, bounds = _coded(raw, words[first : first + int(at.max()) + PASSAGE + 1], space)
        name, name2 = Hasher(codes).names(bounds[at], bounds[at + PASSAGE], np.zeros(len(at), np.int64))
        yield _record(1, len(at), start=along, name=name, name2=name2, **{f: own[f][which] for f in ("run", "run2", "low", "high")})


def _record(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _covering(docs: DataFrame) -> DataFrame:
    """kind, doc_id, mark, start, stop: intervals that hold a repeated string, overlapping ones included; of bytes (kind 0) and words (kind 1)."""
    context = small_batches(docs).sparkContext
    keys = docs.select("text").mapInPandas(_sampled_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    repeated = context.broadcast(build(keys, BITMAP_LOG2).bits)
    tuples = staged(docs.select("doc_id", "mark", "text").mapInPandas(_tuples(repeated), _TUPLES), "suffix-tuples")
    own = F.xxhash64("doc_id", "mark")
    runs = tuples.groupBy("kind", "key", "run", "run2").agg(F.count("*").alias("rows"), F.min(own).alias("low"), F.max(own).alias("high"), F.min(F.struct("mark", "doc_id", "start", "place", "n")).alias("pick"))
    runs = staged(runs, "suffix-runs")
    several = runs.groupBy("key").agg(F.max("kind").alias("kind"), F.count("*").alias("runs"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("rows").alias("least"), F.max(F.col("low") == F.col("high")).alias("alone"))
    several = staged(several.where("runs > 1 and if(kind = 0, least = 1, low <> high and alone)").select("key"), "suffix-several")
    chosen = runs.join(several.hint("merge"), "key", "left_semi").select("kind", "pick.*", "run", "run2", "low", "high")
    refined = staged(_chosen_texts(docs, staged(chosen, "suffix-chosen")).mapInArrow(_refined, _REFINED), "suffix-refined")

    # Sides that were counted are written before they are joined: both are then plain shuffles, and Spark splits a hot name.
    names = ["run", "run2"]
    whole = tuples.where("kind = 0").join(runs.where("kind = 0 and rows > 1").select(names).hint("merge"), names, "left_semi")
    whole = whole.select("kind", "doc_id", "mark", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop"))
    return whole.unionByName(_settled_blocks(refined.where("kind = 0"))).unionByName(_settled_passages(tuples.where("kind = 1"), runs.where("kind = 1"), refined.where("kind = 1")))


def _chosen_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, mark, text and its chosen runs as parallel arrays, of the documents that have any."""
    fields = ("kind", "start", "place", "n", "run", "run2", "low", "high")
    picks = chosen.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.collect_list(F.struct(*fields)).alias("picks"))
    maybe = maybe_in(build(chosen.select("mark"), BITMAP_LOG2 - 3), docs)
    texts = docs.where(maybe("mark")).join(staged(picks, "suffix-picks").hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    return texts.select("doc_id", "mark", "text", *[F.col(f"picks.{f}").alias(f) for f in fields])


def _settled_blocks(blocks: DataFrame) -> DataFrame:
    """Which windows of the blocks with equal cores are equal."""
    core = ["name", "name2"]
    contexts = staged(blocks.groupBy(*core, "left", "right").agg(F.count("*").alias("n")), "suffix-contexts")
    shared = staged(contexts.groupBy(core).agg(F.sum("n").alias("total")).where("total > 1").select(core), "suffix-shared")
    contexts = contexts.join(shared.hint("merge"), core, "left_semi").withColumn("context", F.struct(*core, "left", "right"))
    j = F.col("j")
    fits = (j <= F.octet_length("left")) & (F.lit(BLOCK - 1) - j <= F.octet_length("right"))
    windows = contexts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).where(fits)
    around = F.concat(F.expr("substring(left, octet_length(left) - j + 1, j)"), F.expr(f"substring(right, 1, {BLOCK - 1} - j)"))
    windows = staged(windows.select(*core, "j", around.alias("around"), "left", "right", "n"), "suffix-block-windows")
    window = [*core, "j", "around"]
    again = staged(windows.groupBy(window).agg(F.sum("n").alias("total")).where("total > 1").select(window), "suffix-windows")
    reach = windows.join(again.hint("merge"), window, "left_semi").groupBy(*core, "left", "right").agg(F.min("j").alias("near"), F.max("j").alias("far"))
    settled = blocks.join(staged(reach, "suffix-reach").hint("merge"), [*core, "left", "right"])  # a block's windows overlap, so the least and the greatest cover all
    return settled.select("kind", "doc_id", "mark", (F.col("start") - F.col("far")).alias("start"), (F.col("start") - F.col("near") + LENGTH).alias("stop"))


def _settled_passages(tuples: DataFrame, runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Where passages stand in several documents: whole runs that do, and of other runs the windows that do."""
    names, window = ["run", "run2"], ["name", "name2"]
    again = staged(windows.groupBy(window).agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select(window), "passage-windows")
    parts = windows.join(again.hint("merge"), window, "left_semi").select(*names, F.col("start").alias("near"), F.col("start").alias("far"))
    whole = runs.where("low <> high").select(*names, F.lit(0).cast("long").alias("near"), (F.col("pick.n") - 1).cast("long").alias("far"))
    reach = whole.unionByName(parts).groupBy(names).agg(F.min("near").alias("near"), F.max("far").alias("far"))  # a run's windows overlap
    found = tuples.join(staged(reach, "passage-reach").hint("merge"), names)
    return found.select("kind", "doc_id", "mark", (F.col("start") + F.col("near")).alias("start"), (F.col("start") + F.col("far") + PASSAGE).alias("stop"))


def _islands(spans: DataFrame) -> DataFrame:
    """kind, doc_id, mark, start, stop: overlapping and touching intervals of a document joined."""
    own = Window.partitionBy("kind", "doc_id", "mark").orderBy("start", "stop")
    before = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(own))
    return marked.groupBy("kind", "doc_id", "mark", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, own in zip(texts, spans, strict=True):
        raw, at, kept = (text or "").encode("utf-8", "surrogatepass"), 0, sha256()
        removed = 0
        own = [] if own is None else sorted(own.tolist())
        for start, stop in zip(own[::2], own[1::2], strict=True):  # disjoint, so sorting all ends keeps them paired
            kept.update(raw[at:start])
            at = stop
            removed += stop - start
        kept.update(raw[at:])
        rows.append((len(raw), removed, len(own) // 2, kept.hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), spans: starts and stops of the maximal removed runs of each text, in no order; passages: the same in words."""
    ends = lambda kind: F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.array("start", "stop"))))
    return _islands(_covering(_marked(docs))).groupBy("doc_id", "mark").agg(ends(0).alias("spans"), ends(1).alias("passages"))


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row. passages adds n_passages, the maximal runs of words in them."""
    texts = _marked(docs)
    spans = staged(repeated_spans(docs), "suffix-spans").withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m")
    maybe = maybe_in(build(spans.select("m"), BITMAP_LOG2 - 3), texts)
    tested = texts.withColumn("maybe", maybe("mark"))
    none, zero = F.lit(None).cast(_SPANS), F.lit(0).cast("long")
    clean = tested.where(~F.col("maybe")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), zero.alias("n_passages"))
    joined = tested.where("maybe").join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    cut = F.pandas_udf(_cut, "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    cut = joined.select("doc_id", cut("text", F.coalesce("spans", none)).alias("r"), (F.coalesce(F.size("passages"), F.lit(0)) / 2).cast("long").alias("n_passages"))
    found = clean.unionByName(cut.select("doc_id", "r.*", "n_passages"))
    return found if passages else found.drop("n_passages")
