"""Phrase collocations: count tries of each shard, merged by ranges of their paths, scored through their links.

A shard is a stretch of a partition of at most SEGMENT words. Its trie, three words deep, is kept as the sorted list of
its maximal paths with their counts: a node's count is the sum over the paths that pass through it. A word's key is a
hash of its language and its letters, so one trie holds all languages. Tries are written to the shared folder, a bounded
sample of their paths gives the cuts, and each range of paths takes its run of every shard and merges the sorted runs.
A cut can go through a node; every range learns the whole count of the (at most four) nodes that its two cuts go
through, so a word or a pair that starts a third of all phrases is spread over many ranges.

In a range, walking down the trie gives a phrase's left parts. Its right part is its suffix link, the node without the
first word: links are followed by joins among the nodes that are frequent enough, pairs to words, then triples to pairs.
A part of a phrase is at least as frequent as the phrase, so no link can lead to a node that was left out.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each time; a
language without candidates has no rows; ties in score and count are in the order of the phrase's bytes; an empty table
gives no rows; other columns are ignored. Should two words of a corpus share a hash, the work is done again with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.common import small_batches, staged

LEAST = 10
TOP = 2000
#: A phrase is dropped where a longer one has at least so many percent of its count.
SUBSUMED = 50
#: Words of a shard: their local numbers fit 21 bits, so a path of three fits 63.
SEGMENT = 2_000_000
BITS = 21
#: One path in so many is a candidate for a cut; so many of them reach the driver at most.
SAMPLE_EVERY, CUT_SAMPLES = 512, 1 << 16
#: Paths of a range, about: what one merge holds.
RANGE_PATHS = 1 << 21
#: Parts of a language that are ranked first.
BUCKETS = 64
_LOW = np.uint64((1 << BITS) - 1)
#: The characters that end a piece become full stops, tabs become spaces.
_PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
_SHARDS = "paths long, keys binary, counts binary, hashes binary, words array<struct<hash:long,lang:string,word:binary>>, totals array<struct<lang:string,n:long>>, sample array<binary>"
_NODES = "depth int, h1 long, h2 long, h3 long, f long, f1 long, f12 long"


class _Numbers(dict):
    """Numbers of one language's words, in a list that all languages share. The full stop, which no word holds, is 0."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b".": 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = n = len(self.words)
        return n


def word_hash(lang: str, word: bytes, seed: int) -> int:
    """64 bits, never 0."""
    name = lang.encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(b"%d:%s%s" % (len(name), name, word), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little") or 1


def _paths(numbers: np.ndarray, starts: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal paths of the first ``starts`` positions and their counts; ranks are 0 at the end of a piece."""
    r = np.concatenate([rank[numbers], np.zeros(2, np.uint64)])
    first, second, third = r[:starts], r[1 : starts + 1], r[2 : starts + 2]
    keys = (first << np.uint64(2 * BITS)) | (second << np.uint64(BITS)) | np.where(second > 0, third, np.uint64(0))
    keys = np.sort(keys[first > 0])
    at = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
    return keys[at], np.diff(np.r_[at, len(keys)]).astype(np.uint32)


def _unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return keys >> np.uint64(2 * BITS), (keys >> np.uint64(BITS)) & _LOW, keys & _LOW


def _shards(seed: int, segment: int):
    """Rows of (lang, text as bytes) to the tries of their shards."""

    def flush(pieces: list[np.ndarray], words: list[tuple[str, bytes]], totals: dict[str, int]) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate(pieces)
        hashes = np.fromiter((word_hash(lang, w, seed) for lang, w in words), np.uint64, len(words))
        rank = np.zeros(len(words) + 1, np.uint64)
        for at in range(0, len(numbers), segment):  # a text longer than a shard goes on in the next, which sees two words more
            part = numbers[at : at + segment + 2]
            used = np.unique(part)
            used = used[used > 0]
            used = used[np.argsort(hashes[used - 1])]
            rank[used] = np.arange(1, len(used) + 1, dtype=np.uint64)
            keys, counts = _paths(part, min(segment, len(numbers) - at), rank)
            rank[used] = 0
            own = hashes[used - 1]
            a, b, c = (np.r_[np.uint64(0), own][x.astype(np.int64)] for x in _unpacked(keys[::SAMPLE_EVERY]))
            row = {
                "paths": len(keys), "keys": np.diff(keys, prepend=np.uint64(0)).tobytes(), "counts": counts.tobytes(), "hashes": own.tobytes(),
                "words": [{"hash": h, "lang": words[i - 1][0], "word": words[i - 1][1]} for h, i in zip(own.view(np.int64).tolist(), used.tolist(), strict=True)],
                "totals": [{"lang": k, "n": n} for k, n in totals.items()] if at == 0 else [],
                "sample": [x.tobytes() for x in np.column_stack([a, b, c])],
            }
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema(
        [("paths", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("words", pa.list_(pa.struct([("hash", pa.int64()), ("lang", pa.string()), ("word", pa.binary())])))]
        + [("totals", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))), ("sample", pa.list_(pa.binary()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words, totals, by_lang, size = [], [], {}, {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = text.lower().translate(_PIECES).replace(b".", b" . ").split()
                if size and size + len(tokens) >= segment:
                    yield from flush(pieces, words, totals)
                    pieces, words, totals, by_lang, size = [], [], {}, {}, 0
                if lang not in by_lang:
                    by_lang[lang] = _Numbers(lang, words)
                tokens.append(b".")
                numbers = np.fromiter(map(by_lang[lang].__getitem__, tokens), np.int32, len(tokens))
                if n := int(np.count_nonzero(numbers)):
                    pieces.append(numbers)
                    size += len(numbers)
                    totals[lang] = totals.get(lang, 0) + n
        if size:
            yield from flush(pieces, words, totals)

    return run


def _ranks_of(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each wanted hash, or of the next greater one; whether it is there. 0, the end of a path, is always there."""
    at = np.searchsorted(hashes, wanted)
    there = np.append(hashes, np.uint64(0))[at] == wanted
    return np.where(wanted == 0, 0, at + 1).astype(np.uint64), there | (wanted == 0)


def _cut_up(keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each cut falls in a shard's paths; and of the nodes (first word, first two words) that it goes through, the whole count and that before the cut."""
    (a, has_a), (b, has_b), (c, _) = (_ranks_of(hashes, cuts[:, i]) for i in range(3))
    two, one = np.uint64(2 * BITS), np.uint64(BITS)
    low = a << two
    pair = low | (b << one)
    at = np.searchsorted(keys, np.where(has_a, np.where(has_b, pair | c, pair), low))
    upto = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    here = upto[at]

    def through(there: np.ndarray, first: np.ndarray, step: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        begin, end = upto[np.searchsorted(keys, first)], upto[np.searchsorted(keys, first + step)]
        return np.where(there, end - begin, 0), np.where(there, here - begin, 0)

    whole1, before1 = through(has_a, low, np.uint64(1) << two)
    whole2, before2 = through(has_a & has_b & (cuts[:, 1] > 0), pair, np.uint64(1) << one)
    return at, np.column_stack([whole1, before1, whole2, before2])


def _runs(cuts):
    """A shard's trie to its runs, one for each range that has paths of it or is cut through a node of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = cuts.value
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, hashes = np.cumsum(np.frombuffer(row["keys"], np.uint64), dtype=np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["hashes"], np.uint64)
                at, spines = _cut_up(keys, counts, hashes, where)
                nothing = np.zeros((1, 4), np.int64)
                ends = np.column_stack([np.concatenate([nothing, spines]), np.concatenate([spines, nothing])])
                out = []
                for k, (lo, hi) in enumerate(zip(np.r_[0, at], np.r_[at, len(keys)], strict=True)):
                    if lo == hi and not ends[k].any():
                        continue
                    parts = [x.astype(np.int64) for x in _unpacked(keys[lo:hi])]
                    if hi - lo > len(hashes) // 8:
                        flags = np.zeros(len(hashes) + 1, bool)
                        for x in parts:
                            flags[x] = True
                        used = np.flatnonzero(flags)
                    else:
                        used = np.unique(np.concatenate(parts))
                    used = used[used > 0]
                    rank = np.zeros(len(hashes) + 1, np.uint64) if hi - lo > len(hashes) // 8 else None
                    if rank is not None:
                        rank[used] = np.arange(1, len(used) + 1, dtype=np.uint64)
                        a, b, c = (rank[x] for x in parts)
                    else:
                        a, b, c = (np.where(x > 0, np.searchsorted(used, x) + 1, 0).astype(np.uint64) for x in parts)
                    n = counts[lo:hi]
                    packed = (a << np.uint64(2 * BITS)) | (b << np.uint64(BITS)) | c
                    out.append({"range": k, "keys": packed.tobytes(), "counts": (n.astype(np.uint8) if n.max(initial=0) < 256 else n).tobytes(), "hashes": hashes[used - 1].tobytes(), "ends": ends[k].tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("ends", pa.binary())])
    return run


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of one range in one order: paths as hashes (n, 3), their counts, and what the range's cuts go through (8 counts)."""
    own = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    everything = np.unique(np.concatenate(own))
    parts, counts = [[], [], []], []
    for hashes, packed, n in zip(own, rows["keys"], rows["counts"], strict=True):
        keys = np.frombuffer(packed, np.uint64)
        to = np.r_[0, np.searchsorted(everything, hashes) + 1].astype(np.uint64)
        for k, x in enumerate(_unpacked(keys)):
            parts[k].append(to[x.astype(np.int64)])
        counts.append(np.frombuffer(n, np.uint8 if len(n) == len(keys) else np.uint32).astype(np.int64))
    (a, b, c), n = (np.concatenate(x) for x in parts), np.concatenate(counts)
    if len(everything) < 1 << BITS:
        order = np.argsort((a << np.uint64(2 * BITS)) | (b << np.uint64(BITS)) | c, kind="stable")  # sorted runs: a merge
    else:
        order = np.lexsort((c, (a << np.uint64(32)) | b))
    a, b, c, n = a[order], b[order], c[order], n[order]
    at = np.flatnonzero(np.r_[len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    known = np.r_[np.uint64(0), everything]
    paths = np.column_stack([known[x[at].astype(np.int64)] for x in (a, b, c)])
    ends = np.sum([np.frombuffer(x, np.int64) for x in rows["ends"]], axis=0)
    return paths, np.add.reduceat(n, at) if len(at) else n[:0], ends


def _nodes(cuts, least: int):
    """A range's runs to the frequent nodes that start in it, with the counts of their left parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k, where = int(rows["range"].iloc[0]), cuts.value
        paths, n, ends = _merged(rows)
        begin = where[k - 1] if k else None
        end = where[k] if k < len(where) else None

        def level(depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """First path, whole count and ownership of each node of this depth; each path's node."""
            same = np.ones(max(len(paths) - 1, 0), bool)
            for i in range(depth):
                same &= paths[1:, i] == paths[:-1, i]
            at = np.flatnonzero(np.r_[len(paths) > 0, ~same])
            f, mine = np.add.reduceat(n, at) if len(at) else n[:0], np.ones(len(at), bool)
            for cut, of, first in ((begin, ends[:4], True), (end, ends[4:], False)):
                if cut is not None:
                    hit = (paths[at, :depth] == cut[:depth]).all(axis=1)
                    f = np.where(hit, of[2 * depth - 2], f)
                    if first:
                        mine &= ~hit | (of[2 * depth - 1] == 0)
            return at, f, mine, np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(paths)]))

        at1, f1, mine1, of1 = level(1)
        at2, f2, mine2, of2 = level(2)
        ones = at1[keep1 := (f1 >= least) & mine1]
        twos = at2[keep2 := (f2 >= least) & mine2 & (paths[at2, 1] > 0)]
        threes = np.flatnonzero((n >= least) & (paths[:, 2] > 0))
        signed, none = paths.view(np.int64), np.int64(0)
        h = np.concatenate([signed[ones] * [1, 0, 0], signed[twos] * [1, 1, 0], signed[threes]]) if len(paths) else signed
        return pd.DataFrame(
            {
                "depth": np.repeat([1, 2, 3], [len(ones), len(twos), len(threes)]), "h1": h[:, 0], "h2": h[:, 1], "h3": h[:, 2],
                "f": np.r_[f1[keep1], f2[keep2], n[threes]],
                "f1": np.r_[np.full(len(ones), none), f1[of1[twos]], f1[of1[threes]]],
                "f12": np.r_[np.full(len(ones) + len(twos), none), f2[of2[threes]]],
            }
        )

    return run


def frequent_nodes(docs: DataFrame, least: int = LEAST, segment: int = SEGMENT, ranges: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, words, totals): nodes of the merged trie with at least ``least`` occurrences; hash, lang, word; lang, n."""
    spark = small_batches(docs)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    for seed in range(8):
        shards = staged(texts.mapInArrow(_shards(seed, segment), _SHARDS), "tries", rows_a_file=1)  # a task of a large input gives dozens
        spelt = shards.select(F.explode("words").alias("w")).select("w.hash", F.struct("w.lang", "w.word").alias("w")).groupBy("hash").agg(F.min("w").alias("w"), F.max("w").alias("other"))
        spelt = staged(spelt, "trie-words")
        if spelt.where("w <> other").isEmpty():
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    size = shards.agg(F.sum("paths")).first()[0] or 0
    ranges = ranges or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_PATHS))
    found = shards.select(F.explode("sample").alias("path")).orderBy(F.rand(7)).limit(CUT_SAMPLES).collect()
    sample = np.frombuffer(b"".join(r["path"] for r in found), np.uint64).reshape(-1, 3)
    sample = sample[np.lexsort((sample[:, 2], sample[:, 1], sample[:, 0]))]
    picks = np.unique(np.arange(1, ranges) * len(sample) // ranges)
    cuts = np.unique(sample[picks], axis=0) if len(sample) else sample
    shared = spark.sparkContext.broadcast(cuts)  # CUT_SAMPLES paths at most, whatever the corpus
    runs = shards.select("keys", "counts", "hashes").mapInArrow(_runs(shared), "range int, keys binary, counts binary, hashes binary, ends binary")
    nodes = staged(runs.groupBy("range").applyInPandas(_nodes(shared, least), _NODES), "trie-nodes")
    totals = shards.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    return nodes, spelt.select("hash", "w.lang", F.col("w.word").cast("string").alias("word")), totals


def _score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)), exact: counts below 10**15, decimals of up to 37 digits."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})")


def mine_collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, segment: int = SEGMENT, ranges: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of two and three words."""
    nodes, words, totals = frequent_nodes(docs, least, segment, ranges)
    single = nodes.where("depth = 1").select(F.col("h1").alias("h2"), F.col("f").alias("r"))
    pairs = nodes.where("depth = 2").select("h1", "h2", F.col("f").alias("a"), F.col("f1").alias("l")).join(single, "h2")
    pairs = staged(pairs, "trie-pairs")
    suffix = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    triples = nodes.where("depth = 3").select("h1", "h2", "h3", F.col("f").alias("a"), "f1", "f12").join(suffix, ["h2", "h3"])
    triples = staged(triples, "trie-triples")

    inside = F.array(F.when(100 * F.col("a") >= SUBSUMED * F.col("f12"), F.struct("h1", "h2")), F.when(100 * F.col("a") >= SUBSUMED * F.col("f23"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2"))))
    dropped = triples.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).select("x.h1", "x.h2").distinct()
    kept = pairs.join(dropped, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(0).cast("long").alias("h3"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    cut1, cut2 = _score("a", "f1", "f23"), _score("a", "f12", "f3")
    chosen = triples.withColumn("s1", cut1).withColumn("s2", cut2).withColumn("first", F.col("s1") <= F.col("s2"))
    longer = chosen.select("h1", "h2", "h3", "a", F.when(F.col("first"), F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(F.col("first"), F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    candidates = staged(kept.unionByName(longer), "trie-candidates")

    needed = candidates.select(F.explode(F.array("h1", "h2", "h3")).alias("hash")).where("hash <> 0").distinct()
    spelt = staged(words.join(needed, "hash", "left_semi"), "trie-spelt")
    word = lambda k: spelt.select(F.col("hash").alias(f"h{k}"), F.col("word").alias(f"w{k}"), *[F.col("lang")] * (k == 1))
    named = candidates.join(word(1), "h1").join(word(2), "h2").join(word(3), "h3", "left")
    named = named.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    heat = named.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))  # a language's last task gets top * BUCKETS rows at most
    first = heat.withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("place") <= top).drop("bucket", "place")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
