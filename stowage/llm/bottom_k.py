"""Near copies by bottom-k sketches of one hash function, confirmed on full sets, and their connected components.

A document is the set of its distinct four-word shingles. Its sketch is the K least of their hashes: the whole set where
it has no more. Documents with equal sets are one node. The K least hashes of a union are a uniform sample of it, and
those of them that both sets have stand in both sketches, so two documents that link share at least SHARED of them (the
chance that a sample of K holds fewer is under 10**-12 a pair; sets that are sketched whole share four fifths). So each
document is entered under its K - SHARED + 1 rarest retained values only, and every link has a common inverted list.

Lists generate overlaps: each list pairs its points with two hubs, the least by two hashes. A list as frequent as a common
passage is dealt out in blocks whose first points have a hub of their own, so no task gathers it. Pairs are filtered by
the estimate from the sketch of their union, by the upper halves of its hashes, and verified on their words. Lists whose points still lie in several
components are then searched in pairs of blocks for links across components, each in the least list that holds both, by
whole sets of hashes and again on words. Every link thus lies inside one component or has been tried.

Defined results: null and empty texts have no shingles and are a component of their own; with fewer than four words the
whole sequence is one shingle; rows with equal sets are linked, repeated rows included; rows with a null doc_id link
like others and a component's id is its least non-null doc_id, or null; kept compares ids with null equal to null, so a
component of rows without ids keeps them all, and repeated rows of a kept id stay; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.bitmap import Bitmap, build, maybe_in, mixed
from stowage.llm.common import kept, scratch_of, small_batches, staged
from stowage.llm.components import connected_components
from stowage.llm.ngram_join import _names, _shared_names, _WordHashes

WORDS = 4
#: 100 * shared >= PERCENT * union.
PERCENT = 80
#: Values of a sketch, and how many of the K least of a union two linked documents share at least.
K, SHARED = 128, 64
#: Entries of a list that one task takes; more are dealt out in blocks. Points of one side of a pair of blocks.
HOT, BLOCK = 2048, 2048
#: Values of a slice, about; groups of the counts that tell rare values, least and most (a broadcast of 64 MB).
SLICE_VALUES, LEAST_GROUPS, MOST_GROUPS = 1 << 21, 1 << 18, 1 << 24
COUNT_PARTS, BITMAP_LOG2 = 16, 25
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_POINT = "doc_id long, key long, length long, n int, node long, check long, sketch binary"


def shingle_hashes(text: bytes, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles. bytes.lower and bytes.split know ASCII letters and white space only."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h)
    if n < WORDS:
        return mixed((h * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = h[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        total += h[k : n - WORDS + 1 + k] * _ODD[k]
    return np.unique(mixed(total))


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """The set itself."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return ({tuple(words)} if words else set()) if len(words) < WORDS else set(zip(*(words[k:] for k in range(WORDS)), strict=False))


def linked(shared, n, m):
    return 100 * shared >= PERCENT * (n + m - shared)


def could_link(n, m):
    """Whether sets of these sizes can link at all."""
    return linked(np.minimum(n, m), n, m)


def entries(n):
    """Under how many of its rarest values a set of n shingles is entered. Up to PERCENT of K all that it can link with is sketched whole."""
    whole = 100 * n <= PERCENT * K
    return np.minimum(n, K) - np.where(whole, (PERCENT * n + 99) // 100, SHARED) + 1


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """The estimate from the sketch of the union; for sets sketched whole, what their hashes say."""
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    if n <= K and m <= K:
        return bool(linked(int(twice.sum()), n, m))
    first = np.r_[True, ~twice]  # the union in order, each value once
    union = both[first]
    shared = both[1:][twice]
    limit = union[min(K, len(union)) - 1]
    return bool(could_link(n, m)) and int((shared <= limit).sum()) >= SHARED


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = _WordHashes()
    for batch in batches:
        rows = []
        for doc_id, key, text in zip(batch["doc_id"].astype("Int64"), batch["key"], batch["text"], strict=True):
            s = shingle_hashes(text, hashes)
            rows.append((doc_id, key, len(text), len(s), *_names(s), s[:K].tobytes()))
        frame = pd.DataFrame(rows, columns=["doc_id", "key", "length", "n", "node", "check", "sketch"])
        frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
        yield frame


def _group_counts(groups: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(groups, np.int64)
        for batch in batches:
            if len(batch):
                counts += np.bincount((np.frombuffer(b"".join(batch["sketch"]), np.uint64) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.any():
            parts = np.minimum(counts, 2**32 - 1).astype(np.uint32).reshape(COUNT_PARTS, -1)
            yield pd.DataFrame({"part": np.arange(COUNT_PARTS), "data": [p.tobytes() for p in parts]})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["data"])
    return pd.DataFrame({"part": rows["part"].iloc[:1], "data": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _entered(rarity, slices: int, hot: int):
    """Points to the entries of their rarest values, packed by slice. An entry: value, block, node, size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = rarity.value
        last = np.uint64(len(counts) - 1)
        for batch in batches:
            if not len(batch):
                continue
            nodes, sizes = batch["node"].to_numpy(np.int64), batch["n"].to_numpy(np.int32)
            values, own = [], entries(sizes.astype(np.int64))
            for sketch, p in zip(batch["sketch"], own.tolist(), strict=True):
                s = np.frombuffer(sketch, np.uint64)
                if p < len(s):
                    order = (counts[(s & last).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (mixed(s) >> np.uint64(32))
                    s = s[np.argpartition(order, p - 1)[:p]]
                values.append(s)
            owner = np.repeat(np.arange(len(batch)), [len(v) for v in values])
            values = np.concatenate(values)
            blocks = -(-counts[(values & last).astype(np.int64)].astype(np.int64) // hot)
            block = np.where(blocks > 1, (mixed(nodes.view(np.uint64) + np.uint64(5)) >> np.uint64(32)).astype(np.int64)[owner] % np.maximum(blocks, 1), -1)
            part = (mixed(values + block.view(np.uint64) * _ODD[0]) % np.uint64(slices)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            # Half a value tells it from the others of its slice; two that are alike there share a list, which costs work only.
            part, values, block, owner = part[by], (mixed(values) >> np.uint64(32)).astype(np.uint32)[by], block[by].astype(np.int32), owner[by]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(part)], strict=True):
                who, at = np.unique(owner[lo:hi], return_inverse=True)
                rows.append((int(part[lo]), values[lo:hi].tobytes(), block[lo:hi].tobytes(), at.astype(np.uint16 if len(who) < 65536 else np.uint32).tobytes(), nodes[who].tobytes(), sizes[who].tobytes()))
            yield pd.DataFrame(rows, columns=["slice", "values", "blocks", "owners", "nodes", "sizes"])

    return run


def _lists(rows: pd.DataFrame) -> pd.DataFrame:
    """One slice. kind 0: pairs (a, b); kind 1: lists of three or more (list a, node b), equal ones once, blocks under their value; kind 2: first points of blocks (value a, node b, size n)."""
    value, block, node, n = [], [], [], []
    for r in rows.itertuples(index=False):
        v = np.frombuffer(r.values, np.uint32)
        at = np.frombuffer(r.owners, np.uint16 if len(r.owners) == 2 * len(v) else np.uint32)
        value.append(v)
        block.append(np.frombuffer(r.blocks, np.int32))
        node.append(np.frombuffer(r.nodes, np.int64)[at])
        n.append(np.frombuffer(r.sizes, np.int32)[at])
    value, block, node, n = (np.concatenate(x) for x in (value, block, node, n))
    by = np.lexsort((mixed(node.view(np.uint64) + np.uint64(7)), block, value))
    value, block, node, n = value[by], block[by], node[by], n[by]
    starts = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (block[1:] != block[:-1])])
    length = np.diff(np.r_[starts, len(value)])
    # Hubs: the least point by each of two hashes of the node, so the many lists of a group of copies have few hubs and give the same pairs.
    first, here = np.repeat(starts, length), np.arange(len(value))
    again = np.lexsort((mixed(node.view(np.uint64) + np.uint64(11)), block, value))
    second = np.repeat(again[starts], length)
    a, b = np.r_[first, second], np.r_[here, here]
    ok = could_link(n[a].astype(np.int64), n[b].astype(np.int64)) & (node[a] != node[b])
    pairs = np.unique(np.column_stack([np.minimum(node[a], node[b])[ok], np.maximum(node[a], node[b])[ok]]), axis=0)
    # a list's name: the sum of its mixed nodes; lists with the same points search the same pairs
    names = np.add.reduceat(mixed(node.view(np.uint64)), starts)
    blocked = block[starts] >= 0
    _, once = np.unique(names, return_index=True)
    pick = np.union1d(once[(length[once] >= 3) & ~blocked[once]], np.flatnonzero(blocked))
    names = np.where(blocked, mixed(value[starts].astype(np.uint64)), names).view(np.int64)
    member = np.concatenate([np.arange(starts[i], starts[i] + length[i]) for i in pick]) if len(pick) else np.empty(0, np.int64)
    heads = starts[blocked]
    return pd.DataFrame(
        {
            "kind": np.repeat([0, 1, 2], [len(pairs), len(member), len(heads)]),
            "a": np.r_[pairs[:, 0], np.repeat(names[pick], length[pick]), value[heads].astype(np.int64)],
            "b": np.r_[pairs[:, 1], node[member], node[heads]],
            "n": np.r_[np.zeros(len(pairs) + len(member), np.int64), n[heads]],
        }
    )


def _halved(wanted):
    """The points that may be wanted, with the upper halves of their sketches' hashes, which keep their order: two hashes alike there make two sets look nearer, never farther."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = Bitmap(wanted.value)
        for batch in batches:
            near = batch[filter_.has(batch["node"].to_numpy(np.int64))]
            if len(near):
                yield near.assign(sketch=[_upper(np.frombuffer(x, np.uint64)).tobytes() for x in near["sketch"]])

    return run


def _may_link(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([may_link(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), i, j) for x, y, i, j in zip(a, b, n, m, strict=True)], dtype=bool)


def _verify(a: pd.Series, b: pd.Series) -> pd.Series:
    last, r, out = None, set(), []
    for x, y in zip(a, b, strict=True):
        if y != last:
            last, r = y, shingles(y)
        s = shingles(x)
        out.append(bool(s) and bool(r) and bool(linked(len(s & r), len(s), len(r))))
    return pd.Series(out, dtype=bool)


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A node's whole set in order: the hashes of a set that is sketched whole, the upper halves of the hashes of a larger one."""
    hashes = _WordHashes()
    for batch in batches:
        sets = [shingle_hashes(t.encode("utf-8", "surrogatepass"), hashes) for t in batch["text"]]
        yield pd.DataFrame({"node": batch["node"], "n": [len(s) for s in sets], "set": [(s if len(s) <= K else _upper(s)).tobytes() for s in sets]})


def _upper(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)


def shared_of(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many hashes two sets share at most, and how many fewer it may be but for a chance of 10**-12.

    Two whole sketches tell it exactly. Of halves, any two that are alike count, in one set or across.
    """
    if a.dtype == b.dtype == np.uint64:
        return len(np.intersect1d(a, b, assume_unique=True)), 0
    both = np.sort(np.concatenate([x if x.dtype == np.uint32 else _upper(x) for x in (a, b)]))
    mean = len(both) ** 2 / 2**33
    fewer, chance = 0, mean
    while chance > 1e-12:
        fewer += 1
        chance *= mean / (fewer + 1)
    return int((both[1:] == both[:-1]).sum()), fewer


def _tops(component: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Components by local numbers, and a forest over them."""
    _, local = np.unique(component, return_inverse=True)
    return local, list(range(int(local.max()) + 1))


def _uncovered(name: int, n: np.ndarray, component: np.ndarray, lists: list[frozenset]):
    """For each point the others that it may link with across components, were they not told by a list before this one.

    The 64 most frequent of the earlier lists are told by bits, so what is left is a little more than needed.
    """
    often = Counter(x for own in lists for x in own if x < name).most_common(64)
    bit = {x: 1 << k for k, (x, _) in enumerate(often)}
    bits = np.array([sum(bit.get(x, 0) for x in own) for own in lists], np.uint64)
    return lambda x: (bits & bits[x] == 0) & could_link(n, n[x]) & (component != component[x])


def _needed_of(cell: tuple, sides: list[list[tuple]]) -> list[tuple]:
    """The points of a pair of blocks that have any other to be compared with."""
    same = cell[1] == cell[2]
    rows = sides[0] if same else sides[0] + sides[1]
    component = np.array([r[1] for r in rows], np.int64)
    if not rows or component.min() == component.max():
        return []
    cut, used = len(sides[0]), np.zeros(len(rows), bool)
    may = _uncovered(cell[0], np.array([r[2] for r in rows], np.int64), component, [frozenset(r[3].tolist()) for r in rows])
    for x in range(len(rows) if same else cut):
        near = may(x)
        near[: x + 1 if same else cut] = False
        if near.any():
            used[x] = True
            used |= near
    return [(*cell, 0 if k < cut else 1, rows[k][0], rows[k][1]) for k in np.flatnonzero(used).tolist()]


def _needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by list and pair of blocks; one pair is held at a time."""
    columns = ["list", "i", "j", "side", "node", "component"]
    now, sides = None, [[], []]
    for batch in batches:
        found: list[tuple] = []
        for name, i, j, side, *point in batch.itertuples(index=False):
            if (name, i, j) != now:
                if now:
                    found += _needed_of(now, sides)
                now, sides = (name, i, j), [[], []]
            sides[side].append(tuple(point))
        if found:
            yield pd.DataFrame(found, columns=columns)
    if now and (found := _needed_of(now, sides)):
        yield pd.DataFrame(found, columns=columns)


def _search_cell(name: int, sides: list[list[tuple]], same: bool) -> list[tuple[int, int]]:
    """Links that join components across one pair of blocks, a forest of them, each in the least of the lists that hold both ends.

    A pair that shares an earlier list is left to that. What two sketches have in common comes from an inverted index of the cell, and who may link is compared whole. Sets that are sketched
    whole are told exactly. Halves of larger sets' hashes can mislead by a few at the border: such pairs are given too, but don't join anything here.
    """
    rows = sides[0] if same else sides[0] + sides[1]
    if not rows:
        return []
    cut = len(sides[0])
    component, top = _tops(np.array([r[1] for r in rows], np.int64))
    if len(top) == 1:
        return []

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    n = np.array([r[2] for r in rows], np.int64)
    sets = [np.frombuffer(r[3], np.uint64 if r[2] <= K else np.uint32) for r in rows]
    sketches = [_upper(s) if s.dtype == np.uint64 else s[:K] for s in sets]
    lists = [frozenset(r[4].tolist()) for r in rows]
    may = _uncovered(name, n, component, lists)
    lengths = [len(s) for s in sketches]
    values, group = np.unique(np.concatenate(sketches), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), lengths)
    order = np.argsort(group, kind="stable")
    posted, at = owner[order], np.searchsorted(group[order], np.arange(len(values) + 1))
    begins = np.r_[0, np.cumsum(lengths)]
    found = []
    for x in range(len(rows) if same else cut):
        near = may(x)
        near[: x + 1 if same else cut] = False
        roots = np.array([find(c) for c in range(len(top))])[component] if found else component
        near &= roots != roots[x]
        if not near.any():
            continue
        own = group[begins[x] : begins[x + 1]]
        shared = np.bincount(np.concatenate([posted[at[g] : at[g + 1]] for g in own.tolist()]), minlength=len(rows))
        whole = (n <= K) & (n[x] <= K)
        for y in np.flatnonzero(near & np.where(whole, linked(shared, n, n[x]), shared >= SHARED)).tolist():
            if find(component[x]) == find(component[y]) or name != min(lists[x] & lists[y]):
                continue
            both, fewer = shared_of(sets[x], sets[y])
            if linked(both, n[x], n[y]):
                found.append((min(rows[x][0], rows[y][0]), max(rows[x][0], rows[y][0])))
                if linked(both - fewer, n[x], n[y]):
                    top[find(component[x])] = find(component[y])
    return found


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by list and pair of blocks; one pair is held at a time."""
    now, sides = None, [[], []]
    for batch in batches:
        found: list[tuple[int, int]] = []
        for name, i, j, side, *point in batch.itertuples(index=False):
            if (name, i, j) != now:
                if now:
                    found += _search_cell(now[0], sides, now[1] == now[2])
                now, sides = (name, i, j), [[], []]
            sides[side].append(tuple(point))
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])
    if now and (found := _search_cell(now[0], sides, now[1] == now[2])):
        yield pd.DataFrame(found, columns=["a", "b"])


def _across(lists: DataFrame, labels: DataFrame, points: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Pairs to verify from lists whose points still lie in several components. What is staged for them goes once they are stored."""
    with scratch_of(lists.sparkSession, "across"):
        return kept(_searched(lists, labels, points, texts, block), "sketch-found")


def _searched(lists: DataFrame, labels: DataFrame, points: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    labelled = staged(lists.join(labels.withColumnRenamed("component", "c"), "node", "left").select("list", "node", F.coalesce("c", "node").alias("component")), "sketch-labelled")
    spanning = staged(labelled.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("list", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "sketch-spanning")
    members = staged(labelled.join(spanning, "list"), "sketch-members")
    names = staged(members.groupBy("node").agg(F.collect_list("list").alias("names")), "sketch-names")  # at most ``entries`` of one node
    own = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "component")
    keys = ("list", "i", "j")
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = staged(names.join(points.select("node", F.col("n").cast("long").alias("n"), "key", "length"), "node"), "sketch-told")
    slim = dealt.join(told.select("node", "n", "names"), "node").select(*keys, "side", "node", "component", "n", "names")
    needed = slim.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(_needed, "list long, i int, j int, side int, node long, component long")
    needed = staged(needed, "sketch-cells")
    searched = staged(told.join(needed.select("node").distinct(), "node", "left_semi"), "sketch-searched")
    sets = _texts_of(searched.select("node", "key", "length"), texts).mapInPandas(_full_sets, "node long, n long, set binary")
    sets = staged(sets, "sketch-sets")
    whole = needed.join(searched.select("node", "names").hint("merge"), "node").join(sets.hint("merge"), "node").select(*keys, "side", "node", "component", "n", "set", "names")
    return whole.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(_search, "a long, b long").distinct()


def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of the wanted nodes (node, key, length). Texts that none needs don't move: a filter of fixed size tells them."""
    maybe = maybe_in(build(wanted.select("key"), BITMAP_LOG2), texts)
    once = texts.where(maybe("key")).groupBy("key", "length").agg(F.max("text").alias("text"))  # the join below finds them dealt out
    return once.join(wanted.hint("merge"), ["key", "length"]).select("node", "text")


def _verified(pairs: DataFrame, points: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs that link, staged: estimated on their sketches, then compared on their words. What is staged for them goes once they are stored.

    Sides that grow with the corpus are merged, so what moves follows the input at any size.
    """
    estimate, verify = F.pandas_udf(_may_link, "boolean"), F.pandas_udf(_verify, "boolean")
    ends = lambda of: of.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    with scratch_of(texts.sparkSession, "verified"):
        pairs = staged(pairs, "sketch-pairs")
        wanted = texts.sparkSession.sparkContext.broadcast(build(ends(pairs), BITMAP_LOG2).bits)  # points that no pair needs don't move
        near = points.select("node", "n", "key", "length", "sketch").mapInPandas(_halved(wanted), "node long, n int, key long, length long, sketch binary")
        needed = staged(near, "sketch-needed")
        one = needed.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        two = needed.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
        hopeful = staged(both.where(estimate("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b"), "sketch-hopeful")
        wanted = needed.select("node", "key", "length").join(ends(hopeful), "node", "left_semi")
        known = staged(_texts_of(staged(wanted, "sketch-wanted"), texts), "sketch-texts")
        one, two = (known.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
        linking = hopeful.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(verify("text_a", "text_b"))
        return kept(linking.select("a", "b"), name)


def _points(documents: DataFrame) -> DataFrame:
    """node, n, sketch, key, length, once a node. Only rows of sets that several have are moved: a filter of fixed size tells the others."""
    several = documents.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1").select("node")
    told = documents.withColumn("several", maybe_in(build(several, BITMAP_LOG2), documents)("node"))
    same = told.where("several").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min(F.struct("key", "length")).alias("t"))
    return told.where("not several").select("node", "n", "sketch", "key", "length").unionByName(same.select("node", "n", "sketch", "t.key", "t.length"))


def near_copies(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = small_batches(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("length"), text.alias("text"))
    with scratch_of(spark, "sketches"):
        documents = staged(texts.select("doc_id", "key", text.cast("binary").alias("text")).mapInPandas(_sketches, _POINT), "sketches")
        if shared_names := _shared_names(documents):
            keeps = F.create_map(*[F.lit(x) for pair in shared_names.items() for x in pair])
            documents = documents.withColumn("node", F.when(F.coalesce(keeps[F.col("node")], F.col("check")) == F.col("check"), F.col("node")).otherwise(F.col("check")))
        points = kept(_points(documents.where("n > 0")), "sketch-points")
        documents = kept(documents.select("doc_id", "n", "node"), "sketch-documents")

    retained = points.agg(F.sum(F.least("n", F.lit(K)))).first()[0] or 0
    groups = 1 << int(np.clip(int(retained // 64).bit_length(), LEAST_GROUPS.bit_length() - 1, MOST_GROUPS.bit_length() - 1))
    slices = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(retained) // SLICE_VALUES))
    sums = points.select("sketch").mapInPandas(_group_counts(groups), "part int, data binary").groupBy("part").applyInPandas(_added, "part int, data binary").collect()
    rarity = np.concatenate([np.frombuffer(r["data"], np.uint32) for r in sorted(sums, key=lambda r: r["part"])]) if sums else np.zeros(groups, np.uint32)
    shared = spark.sparkContext.broadcast(rarity)  # MOST_GROUPS numbers at most, whatever the corpus
    entered = points.select("node", "n", "sketch").mapInPandas(_entered(shared, slices, hot), "slice int, values binary, blocks binary, owners binary, nodes binary, sizes binary")
    found = staged(entered.groupBy("slice").applyInPandas(_lists, "kind int, a long, b long, n long"), "sketch-lists")
    lists = staged(found.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("node")).distinct(), "sketch-list-members")
    heads = staged(found.where("kind = 2").select("a", "b"), "sketch-heads")
    hubs = heads.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("hub"))
    between = heads.join(hubs, "a").where("b <> hub").select(F.least("b", "hub").alias("a"), F.greatest("b", "hub").alias("b"))
    tried = staged(found.where("kind = 0").select("a", "b").unionByName(between).distinct(), "sketch-tried")
    links = _verified(tried, points, texts, "sketch-links")
    labels = staged(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "sketch-labels")
    more = _verified(_across(lists, labels, points, texts, block).join(tried, ["a", "b"], "left_anti"), points, texts, "sketch-more-links")
    if not more.isEmpty():
        labels = staged(connected_components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))), "sketch-labels")

    rows = documents.join(labels.withColumnRenamed("component", "c"), "node", "left").select("doc_id", "n", F.coalesce("c", "node").alias("class"))
    rows = staged(rows, "sketch-classes")
    ids = staged(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")), "sketch-ids")
    named = rows.join(ids, "class", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
