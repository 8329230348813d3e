"""Exact self-join of documents on the Jaccard similarity of their word shingles, and its connected components.

A document is the set of its distinct five-word shingles; documents with equal sets are one node. Tokens are hashed
into groups, and a node's group counts are a point. Two sets can't share more than the sum of their coordinate minima,
so that sum bounds the overlap and prunes pairs; the pairs that survive are verified on their words.

Points of unrelated documents are so alike in any number of dimensions that a single tree over the corpus would
compare nearly everything with everything. So the top of the index is an inverted list: a link needs a common token
among the rarest quarter of either set (rare by corpus-wide group counts), which deals the points into lists. Round
one pairs each list's points with its first point and with their neighbours in size. After the links' components are
known, only lists that still span several components are searched again: their points are packed into trees whose
nodes keep coordinate maxima, and pairs across components whose bound allows a link are verified too, each by the least of the lists it lies in. Every link thus
lies inside one component or has been verified, whatever the size of a group of copies.

Defined results: null and empty texts have no shingles and are a component of their own; with fewer than five words
the whole sequence is one shingle; rows with equal sets are linked, repeated rows included; rows with a null doc_id
link like all others, a component's id is its least non-null doc_id, null where it has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.bitmap import build, maybe_in, mixed
from stowage.llm.common import small_batches, staged
from stowage.llm.components import connected_components

WORDS = 5
#: 100 * shared >= PERCENT * union.
PERCENT = 75
#: Groups whose corpus-wide counts order the tokens by rarity: a fixed size, broadcast to all tasks.
RARITY_GROUPS = 1 << 20
#: Points in a leaf of the tree, children of an inner node, points of a list that one task takes.
LEAF, BLOCK = 16, 512
#: Groups that points are folded to for a tree, so that a block's memory doesn't follow its texts' length: the bounds stay valid.
TREE_GROUPS = 4096
#: Prefix tokens that a slice holds, about.
SLICE_TOKENS = 1 << 21
BITMAP_LOG2 = 25
CACHE_WORDS = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. bytes.lower and bytes.split know ASCII letters and white space only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h)
    if n < WORDS:
        return mixed((h * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = h[: n - 4] * _ODD[0]
    for k in range(1, WORDS):
        total += h[k : n - 4 + k] * _ODD[k]
    return np.unique(mixed(total))


def group_counts(tokens: np.ndarray) -> bytes:
    """The point: counts of tokens by group, packed. Groups are a power of two, at least one a token, so points fold."""
    groups = 1 << max(6, len(tokens).bit_length())
    counts = np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    if counts.max(initial=0) > 255:
        return b""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)  # small counts: one to two bits each
    return coder.compress(counts.astype(np.uint8).tobytes()) + coder.flush()


def point(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed, -15), np.uint8) if packed else np.empty(0, np.uint8)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(-1, groups).sum(axis=0) if len(point) > groups else point


def overlap_bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """The sum of coordinate minima, at the coarser of the two numbers of groups. An empty point bounds nothing."""
    if not a or not b:
        return min(n, m)
    x, y = point(a).astype(np.int32), point(b).astype(np.int32)
    groups = min(len(x), len(y))
    return int(np.minimum(folded(x, groups), folded(y, groups)).sum())


def linked(shared, n, m):
    return 100 * shared >= PERCENT * (n + m - shared)


def could_link(n, m):
    """Whether sets of these sizes can link at all."""
    return linked(np.minimum(n, m), n, m)


class CountTree:
    """A packed R-tree over points of one number of groups: leaves of LEAF points, each node with its coordinate maxima."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = -(-len(points) // LEAF) * LEAF
        padded = np.zeros((n, points.shape[1]), points.dtype)
        padded[: len(points)] = points
        self.levels = [padded.reshape(-1, LEAF, points.shape[1]).max(axis=1)]
        while len(self.levels[-1]) > LEAF:
            top = self.levels[-1]
            more = -(-len(top) // LEAF) * LEAF - len(top)
            top = np.concatenate([top, np.zeros((more, top.shape[1]), top.dtype)]) if more else top
            self.levels.append(top.reshape(-1, LEAF, top.shape[1]).max(axis=1))

    def near(self, point: np.ndarray, least: int) -> np.ndarray:
        """Indexes of the points whose summed minima with this one reach ``least``."""
        nodes = np.arange(len(self.levels[-1]))
        for k in range(len(self.levels) - 1, -1, -1):
            nodes = nodes[nodes < len(self.levels[k])]
            nodes = nodes[np.minimum(self.levels[k][nodes], point).sum(axis=1, dtype=np.int64) >= least]
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        nodes = nodes[nodes < len(self.points)]
        return nodes[np.minimum(self.points[nodes], point).sum(axis=1, dtype=np.int64) >= least]


def _describe(slices: int):
    """First pass: a row for each document (kind 0), and this partition's token counts by rarity group (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, rarity = _WordHashes(), np.zeros(RARITY_GROUPS, np.uint32)
        for batch in batches:
            rows = []
            for key, no_id, text in zip(batch["key"], batch["doc_id"].isna(), batch["text"], strict=True):
                s = shingles(text, hashes)
                np.add.at(rarity, (s >> np.uint64(44)).astype(np.int64), 1)
                rows.append((0, no_id, key, zlib.crc32((text or "").encode("utf-8", "surrogatepass")), len(s), *_names(s), group_counts(s) if len(s) else b""))
            frame = pd.DataFrame(rows, columns=["kind", "doc_id", "key", "crc", "n", "node", "check", "data"])
            frame["doc_id"] = frame["key"].astype("Int64").mask(frame["doc_id"].astype(bool))
            yield frame
        if rarity.any():
            parts = rarity.reshape(slices, -1)
            yield pd.DataFrame({"kind": 1, "doc_id": pd.array([None] * slices, dtype="Int64"), "key": 0, "crc": 0, "n": 0, "node": np.arange(slices), "check": 0, "data": [p.tobytes() for p in parts]})

    return run


def _names(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a document's set: its node, and what tells sets apart that share one."""
    digest = blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _node(tokens: np.ndarray, shared: dict[int, int]) -> int:
    """shared: nodes that several sets have, each with the one set that keeps it; the others go by their second name."""
    node, check = _names(tokens)
    return node if shared.get(node, check) == check else check


def _shared_names(documents: DataFrame) -> dict[int, int]:
    """Of N sets about N * N / 2**65 share a 64-bit name: none up to billions of documents, some thousands at 10**12."""
    twice = documents.groupBy("node").agg(F.min("check").alias("keeps"), F.max("check").alias("other")).where("keeps <> other")
    return {r["node"]: r["keeps"] for r in twice.collect()}


def _add_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(rows["data"].iloc[0]) // 4, np.uint64)
    for x in rows["data"]:
        total += np.frombuffer(x, np.uint32)
    return pd.DataFrame({"slice": [int(rows["node"].iloc[0])], "data": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _deal_prefixes(rarity, slices: int, shared_names: dict[int, int]):
    """Second pass: each node's rarest tokens, dealt out by token. A row is one slice's share of a batch, as packed arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts, seen = _WordHashes(), rarity.value, set()
        for batch in batches:
            tokens, owner, nodes, sizes = [], [], [], []
            for text in batch["text"]:
                s = shingles(text, hashes)
                n = len(s)
                if not n or (node := _node(s, shared_names)) in seen:
                    continue
                seen.add(node)
                prefix = n - (PERCENT * n + 99) // 100 + 1
                order = (counts[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (mixed(s + np.uint64(1)) >> np.uint64(32))
                tokens.append(s[np.argpartition(order, prefix - 1)[:prefix]] if prefix < n else s)
                owner.append(np.full(len(tokens[-1]), len(nodes), np.uint32))
                nodes.append(node)
                sizes.append(n)
            if not nodes:
                continue
            t, o = mixed(np.concatenate(tokens)), np.concatenate(owner)
            part = (t % np.uint64(slices)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            t, o, part = (t[by] >> np.uint64(32)).astype(np.uint32), o[by], part[by]
            nodes_, sizes_ = np.array(nodes, np.int64), np.array(sizes, np.int32)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(part)], strict=True):
                who, at = np.unique(o[lo:hi], return_inverse=True)
                rows.append((int(part[lo]), t[lo:hi].tobytes(), at.astype(np.uint16 if len(who) < 65536 else np.uint32).tobytes(), nodes_[who].tobytes(), sizes_[who].tobytes()))
            yield pd.DataFrame(rows, columns=["slice", "tokens", "owner", "nodes", "sizes"])

    return run


def _lists(rows: pd.DataFrame) -> pd.DataFrame:
    """One slice: its lists. Gives pairs to verify (kind 0: a, b) and lists of three or more (kind 1: list, node), equal lists once."""
    tokens, nodes, sizes = [], [], []
    for r in rows.itertuples(index=False):
        t, who = np.frombuffer(r.tokens, np.uint32), np.frombuffer(r.nodes, np.int64)
        at = np.frombuffer(r.owner, np.uint16 if len(r.owner) == 2 * len(t) else np.uint32)
        tokens.append(t)
        nodes.append(who[at])
        sizes.append(np.frombuffer(r.sizes, np.int32)[at])
    t, v, n = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
    by = np.lexsort((v, n, t))
    t, v, n = t[by], v[by], n[by]
    new = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])]  # a node comes from several partitions where copies lie in them
    t, v, n = t[new], v[new], n[new]
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    length = np.diff(np.r_[starts, len(t)])
    first = np.repeat(starts, length)
    here = np.arange(len(t))
    rest = here > first
    a = np.r_[v[first[rest]], v[here[rest] - 1]]
    b = np.r_[v[rest], v[rest]]
    a, b = np.minimum(a, b), np.maximum(a, b)
    ok = could_link(np.r_[n[first[rest]], n[here[rest] - 1]].astype(np.int64), np.r_[n[rest], n[rest]].astype(np.int64)) & (a != b)
    pairs = np.unique(np.column_stack([a[ok], b[ok]]), axis=0)
    # a list's name: the sum of its mixed nodes; lists with the same points search the same pairs
    sums = np.add.reduceat(mixed(v.view(np.uint64)), starts) if len(starts) else np.empty(0, np.uint64)
    _, pick = np.unique(sums, return_index=True)
    pick = pick[length[pick] >= 3]
    member = np.concatenate([np.arange(starts[i], starts[i] + length[i]) for i in pick]) if len(pick) else np.empty(0, np.int64)
    name = np.repeat(sums[pick].view(np.int64), length[pick])
    return pd.DataFrame({"kind": np.r_[np.zeros(len(pairs), np.int32), np.ones(len(member), np.int32)], "a": np.r_[pairs[:, 0], name], "b": np.r_[pairs[:, 1], v[member]]})


def _bounded(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([bool(linked(overlap_bound(w, x, y, z), y, z)) for w, x, y, z in zip(a, b, n, m, strict=True)])


def _verify(a: pd.Series, b: pd.Series) -> pd.Series:
    hashes, last, s = _WordHashes(), None, np.empty(0, np.uint64)
    out = []
    for x, y in zip(a, b, strict=True):
        if x != last:
            last, s = x, shingles(x, hashes)
        r = shingles(y, hashes)
        shared = len(np.intersect1d(s, r, assume_unique=True))
        out.append(bool(len(s) and len(r) and linked(shared, len(s), len(r))))
    return pd.Series(out, dtype=bool)


class _Cell:
    """Points of one side of a block pair, as arrays."""

    def __init__(self, rows: list[tuple]):
        self.node = np.array([r[0] for r in rows], np.int64)
        self.component = np.array([r[1] for r in rows], np.int64)
        self.n = np.array([r[2] for r in rows], np.int64)
        self.raw = [r[3] for r in rows]
        self.lists = [frozenset(r[4].tolist()) for r in rows]

    def points(self, groups: int) -> np.ndarray:
        unbounded = np.full(groups, 2**15, np.int32)  # an empty point bounds nothing
        return np.stack([folded(x, groups) if len(x) else unbounded for x in self.raw])


def _search_cell(name: int, look: _Cell, among: _Cell, same: bool) -> list[tuple[int, int]]:
    """Pairs across components that the count tree can't rule out, each in the least of the lists that hold both."""
    if len(look.node) == 0 or len(among.node) == 0 or (look.component.min() == look.component.max() == among.component.min() == among.component.max()):
        return []
    groups = min(len(x) or 64 for x in [*look.raw, *among.raw])
    tree, queries, out = CountTree(among.points(groups)), look.points(groups), []
    for i, q in enumerate(queries):
        n = look.n[i]
        at = tree.near(q, -(-3 * (n + among.n.min()) // 7))  # a link shares at least 3/7 of both sizes
        at = at[(among.component[at] != look.component[i]) & could_link(among.n[at], n)]
        if not len(at):
            continue
        both = np.minimum(tree.points[at], q).sum(axis=1)
        at = at[linked(both, among.n[at], n)]
        a, own = int(look.node[i]), look.lists[i]
        for j in at.tolist():
            b = int(among.node[j])
            if (not same or a < b) and name == min(own & among.lists[j]):
                out.append((a, b) if a < b else (b, a))
    return out


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by list, size class and blocks; one block pair is held at a time."""
    now, sides = None, ([], [])
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for name, low, i, j, side, node, component, n, packed, names in batch.itertuples(index=False):
            if (name, low, i, j) != now:
                found.update(_searched(now, sides))
                now, sides = (name, low, i, j), ([], [])
            row = (node, component, n, folded(point(packed).astype(np.int32), TREE_GROUPS), names)
            if side != 1:
                sides[0].append(row)
            if side != 0:
                sides[1].append(row)
        if found:
            yield pd.DataFrame(sorted(found), columns=["a", "b"])
    if found := _searched(now, sides):
        yield pd.DataFrame(found, columns=["a", "b"])


def _searched(cell: tuple | None, sides: tuple[list, list]) -> list[tuple[int, int]]:
    if not (cell and sides[0] and sides[1]):
        return []
    return _search_cell(cell[0], _Cell(sides[0]), _Cell(sides[1]), cell[1] % 2 == 0 and cell[2] == cell[3])


def _residual(lists: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """Candidate pairs from lists that still span components.

    A list's points are parted into size classes, of which only equal and neighbouring ones can link, and a long list's
    classes into blocks; a task holds one pair of blocks at a time.
    """
    members = staged(_labelled(lists, labels), "ngram-spanning-members")
    names = members.groupBy("node").agg(F.collect_list("list").alias("names"))  # at most a prefix of lists a node
    names = names.join(points.where(maybe_in(build(members.select("node").distinct(), BITMAP_LOG2), points)("node")).hint("merge"), "node")
    named = staged(members.join(staged(names, "ngram-node-lists").hint("merge"), "node").withColumn("class", _size_class()), "ngram-spanning")
    # Which cells hold two components: within a class, and between a class and the next.
    classes = named.groupBy("list", "class").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    after = Window.partitionBy("list").orderBy("class")
    ahead, behind = F.lead("class").over(after) == F.col("class") + 1, F.lag("class").over(after) == F.col("class") - 1
    mixed_up = ahead & ((F.col("lo") != F.lead("lo").over(after)) | (F.col("hi") != F.lead("hi").over(after)) | (F.col("lo") != F.col("hi")))
    mixed_down = behind & ((F.col("lo") != F.lag("lo").over(after)) | (F.col("hi") != F.lag("hi").over(after)) | (F.col("lo") != F.col("hi")))
    cells = classes.select(
        "list", "class", (F.col("lo") != F.col("hi")).alias("within"), F.coalesce(mixed_up, F.lit(False)).alias("up"), F.coalesce(mixed_down, F.lit(False)).alias("down"),
        F.ceil(F.sum("size").over(Window.partitionBy("list")) / BLOCK).cast("int").alias("blocks"),
    ).where("within or up or down")
    own = named.join(staged(cells, "ngram-cells").hint("merge"), ["list", "class"])
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = lambda low, i, j, side: F.struct(low.alias("low"), i.alias("i"), j.alias("j"), side.alias("side"))
    b, o, c = F.col("block"), F.col("other"), F.col("class")
    inside = place(2 * c, F.least(b, o), F.greatest(b, o), F.when(b == o, 2).when(b < o, 0).otherwise(1))
    places = F.filter(F.array(F.when(F.col("within"), inside), F.when(F.col("up"), place(2 * c + 1, b, o, F.lit(0))), F.when(F.col("down"), place(2 * c - 1, o, b, F.lit(1)))), lambda p: p.isNotNull())
    dealt = others.withColumn("p", F.explode(places)).select("list", "p.low", "p.i", "p.j", "p.side", "node", "component", "n", "point", "names")
    keys = ("list", "low", "i", "j")
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(_search, "a long, b long").distinct()


def _size_class():
    """Sizes that can link differ by one class at most."""
    return F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """list, node, component of the lists that span several components."""
    named = lists.join(labels.withColumnRenamed("component", "c").hint("merge"), "node", "left").select("list", "node", F.coalesce("c", "node").alias("component"))
    named = staged(named, "ngram-labelled")
    spanning = staged(named.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("list"), "ngram-split-lists")
    return named.join(spanning.hint("merge"), "list", "left_semi")


def link_documents(docs: DataFrame, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents has doc_id, key, n_shingles, node; links has a, b, verified pairs of nodes that connect every component."""
    spark = small_batches(docs)
    texts = docs.select("doc_id", "text", text_key().alias("key"))
    described = staged(texts.mapInPandas(_describe(16), "kind int, doc_id long, key long, crc long, n int, node long, check long, data binary"), "ngram-documents")
    documents = described.where("kind = 0")
    shared_names = _shared_names(documents)
    if shared_names:
        keeps = F.create_map(*[F.lit(x) for pair in shared_names.items() for x in pair])
        documents = documents.withColumn("node", F.when(F.coalesce(keeps[F.col("node")], F.col("check")) == F.col("check"), F.col("node")).otherwise(F.col("check")))
    points = staged(documents.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("data").alias("point")), "ngram-points")

    if not slices:
        tokens = points.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
        slices = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(tokens) // SLICE_TOKENS))
    sums = described.where("kind = 1").select("node", "data").groupBy("node").applyInPandas(_add_counts, "slice int, data binary").collect()
    rarity = np.concatenate([np.frombuffer(r["data"], np.uint32) for r in sorted(sums, key=lambda r: r["slice"])]) if sums else np.zeros(RARITY_GROUPS, np.uint32)
    shared = spark.sparkContext.broadcast(rarity)  # RARITY_GROUPS numbers, whatever the corpus
    found = staged(
        texts.select("text")
        .mapInPandas(_deal_prefixes(shared, slices, shared_names), "slice int, tokens binary, owner binary, nodes binary, sizes binary")
        .groupBy("slice")
        .applyInPandas(_lists, "kind int, a long, b long"),
        "ngram-lists",
    )
    lists = staged(found.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("node")).distinct(), "ngram-members")
    tried = found.where("kind = 0").select("a", "b").distinct()
    links = staged(_verified(tried, points, documents, texts), "ngram-links")
    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    pairs = _residual(lists, labels, points).join(tried.hint("merge"), ["a", "b"], "left_anti")
    more = staged(_verified(pairs, points, documents, texts), "ngram-more-links")
    return documents.select("doc_id", "key", F.col("n").alias("n_shingles"), "node"), links.unionByName(more)


def _verified(pairs: DataFrame, points: DataFrame, documents: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link: bounded by their points first, then compared on their words."""
    bounded, verify = F.pandas_udf(_bounded, "boolean"), F.pandas_udf(_verify, "boolean")
    pairs = staged(pairs, "ngram-candidates")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    points = points.where(maybe_in(build(ends, BITMAP_LOG2), points)("node"))  # points that no pair needs don't move
    one = points.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("point_a"))
    two = points.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("point_b"))
    hopeful = staged(pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(bounded("point_a", "point_b", "n_a", "n_b")).select("a", "b"), "ngram-pairs")
    needed = hopeful.select(F.col("a").alias("node")).unionByName(hopeful.select(F.col("b").alias("node"))).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "key", "crc"))
    source = documents.where("n > 0").groupBy("node").agg(first.alias("d")).join(needed, "node").select("node", "d.key", "d.crc")
    wanted = _texts_of(source, texts)
    left = hopeful.join(wanted.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return left.join(wanted.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").where(verify("text_a", "text_b")).select("a", "b")


def _texts_of(source: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text. Texts that no pair needs are left out before the shuffle by a filter of fixed size."""
    maybe = maybe_in(build(source.select("key"), BITMAP_LOG2), texts)
    chosen = texts.where(maybe("key")).select("doc_id", "key", F.crc32("text").alias("crc"), "text")
    # copies without an id share a key, which may be that of a third of all rows: one of each goes on
    without = chosen.where("doc_id is null").groupBy("key", "crc").agg(F.max("text").alias("text"))
    chosen = chosen.where("doc_id is not null").drop("doc_id").unionByName(without)
    return staged(chosen.join(source, ["key", "crc"]).groupBy("node").agg(F.max("text").alias("text")), "ngram-texts")


def text_key():
    """What a row's text is found by: its doc_id, or where that is null its text's hash."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def _classed(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """doc_id, key, n_shingles, least (the least doc_id of the row's component), least_key (of its rows without one) for every row."""
    documents, links = link_documents(docs, slices)
    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = staged(labels.withColumnRenamed("component", "c"), "ngram-labels")
    rows = documents.join(labels.hint("merge"), "node", "left").withColumn("class", F.coalesce("c", "node"))
    rows = staged(rows.select("doc_id", "key", "n_shingles", "class"), "ngram-classes")
    # Written, so the join is of two plain shuffles and a hot class can be split.
    least = [F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNull(), F.col("key"))).alias("least_key")]
    return rows.join(staged(rows.where("n_shingles > 0").groupBy("class").agg(*least), "ngram-ids").hint("merge"), "class", "left")


def near_duplicate_components(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return _classed(docs, slices).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the least doc_id, else that with the least hash of its text.

    Rows without shingles all stay, and so do repeated rows of the document that stays. Columns as given.
    """
    stays = F.when(F.col("least").isNull(), F.col("key") == F.col("least_key")).otherwise(F.col("doc_id") == F.col("least"))
    kept = _classed(docs).where((F.col("n_shingles") == 0) | stays).select(F.col("doc_id").isNull().alias("kept_no_id"), F.col("key").alias("kept")).distinct()
    no_id = F.col("doc_id").isNull().alias("no_id")
    rows = docs.select(F.struct(*docs.columns).alias("row"), no_id, text_key().alias("id"))  # packed: no column of the caller can clash
    return rows.join(kept, (F.col("id") == F.col("kept")) & (F.col("no_id") == F.col("kept_no_id")), "left_semi").select("row.*")
