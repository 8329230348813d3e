import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm.bitmap import build
from stowage.llm.components import connected_components
from stowage.llm.ngram_join import TREE_GROUPS, CountTree, _names, _node, _shared_names, _WordHashes, drop_near_duplicates, group_counts, folded, near_duplicate_components, overlap_bound, point, shingles

from .helpers import ODD, docs


def brute(rows):
    sets = []
    for _, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    texts = list(ODD)
    for _ in range(12):  # families whose members drift apart, so some pairs stand at the threshold
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(5, 120))]
        for _ in range(9):
            texts.append(" ".join(words))
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(0, len(words))] = f"v{rng.integers(0, 400)}"
    ids = rng.permutation(len(texts)).tolist()
    assert got(near_duplicate_components(docs(spark, texts, ids), 5)) == brute(list(zip(ids, texts, strict=True)))


def test_hot_group_of_near_copies(spark):
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join([*base[:i], f"x{k}", *base[i:]]) for k, i in enumerate(np.random.default_rng(3).integers(0, 60, 300))]
    texts += ["other words " + " ".join(base[:30]) + f" tail{k}" for k in range(100)]
    assert got(near_duplicate_components(docs(spark, texts), 3)) == brute(list(enumerate(texts)))


def test_null_ids_and_empty(spark):
    rows = near_duplicate_components(docs(spark, ["a b c", "a B c", "a b c", None], [None, 4, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.n_shingles) for r in rows if r.n_shingles) == [(-1, 4, 1), (4, 4, 1), (9, 4, 1)]
    assert near_duplicate_components(docs(spark, [])).count() == 0


def near(base, k):
    return " ".join([*(f"{base}{i}" for i in range(40)), f"tail{k}"])


def test_near_copies_without_ids_link(spark):
    """Pairs of two rows without an id, of one with and one without, many equal rows without an id, and large ids beside null ones."""
    big = 2**60 + 1
    texts = [near("a", 1), near("a", 2), near("b", 1), near("b", 2), *[near("c", 1)] * 30, near("c", 2), near("d", 1), near("d", 2), "stray words that nothing else has"]
    ids = [None, None, None, 7, *[None] * 30, 5, big, big + 1, None]
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_components(docs(spark, texts, ids), 3).collect()), key=str)
    want = [(None, 37, None)] * 2 + [(None, 37, 7), (7, 37, 7)] + [(None, 37, 5)] * 30 + [(5, 37, 5), (big, 37, big), (big + 1, 37, big), (None, 2, None)]
    assert rows == sorted(want, key=str)
    stay = sorted((r.doc_id, r.text) for r in drop_near_duplicates(docs(spark, texts, ids)).collect() if r.doc_id is not None)
    assert stay == [(5, near("c", 2)), (7, near("b", 2)), (big, near("d", 1))]
    without = [r.text for r in drop_near_duplicates(docs(spark, texts, ids)).collect() if r.doc_id is None]
    assert len(without) == 2 and texts[-1] in without and ({near("a", 1), near("a", 2)} & set(without))


def test_one_document_of_each_group_stays(spark):
    df = docs(spark, ["a b c", "a b c", None, "", "z"], [5, 3, 1, 2, 9])
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 9]


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(5)
    points = rng.poisson(2, (700, 32)).astype(np.int32)
    tree = CountTree(points)
    for least in (0, 40, 50, 60):
        q = points[rng.integers(0, 700)] + rng.integers(0, 2, 32)
        assert sorted(tree.near(q, least)) == np.flatnonzero(np.minimum(points, q).sum(axis=1) >= least).tolist()


def test_bound_never_undercounts():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.r_[rng.choice(a, rng.integers(0, len(a) + 1), replace=False), rng.integers(0, 2**63, rng.integers(0, 400)).astype(np.uint64)])
        if len(b):
            assert overlap_bound(group_counts(a), group_counts(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bitmap_has_all_its_keys(spark):
    keys = np.random.default_rng(8).integers(-(2**63), 2**63 - 1, 1000)
    bitmap = build(spark.createDataFrame([(int(k),) for k in keys], "k long"), 20)
    assert bitmap.has(keys).all() and bitmap.has(np.arange(10_000)).mean() < 0.01


def test_shingles_by_hand():
    h = _WordHashes()
    assert len(shingles("a b c d e f", h)) == 2 and len(shingles("a b", h)) == 1 and len(shingles(None, h)) == 0
    assert (shingles("A b\tC d e", h) == shingles("a B c d\ne", h)).all() and not (shingles("É b", h) == shingles("é b", h)).all()


def test_columns_that_clash(spark):
    df = docs(spark, ["a b c", "a b c", None, "", "z"], [5, 3, 1, 2, 9]).selectExpr("*", "doc_id as kept_doc_id", "'x' as id", "'y' as kept", "'z' as component_id", "1 as node")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.kept_doc_id for r in kept.collect()) == [1, 2, 3, 9]


def test_sets_that_share_a_name(spark):
    texts = ["a b c d e f", "g h i j k l", "a b c d e f", "m n o p q r s", "", None]
    df = docs(spark, texts)
    described = spark.createDataFrame([(1, 5), (1, 5), (1, 9), (2, 4)], "node long, check long")
    assert _shared_names(described) == {1: 5}
    s = shingles(texts[0], _WordHashes())
    node, check = _names(s)
    assert _node(s, {}) == _node(s, {node: check}) == node and _node(s, {node: check + 1}) == check
    assert got(near_duplicate_components(df, 3)) == brute(list(enumerate(texts)))


def test_long_texts_fold_to_bounded_points():
    packed = group_counts(np.unique(np.random.default_rng(9).integers(0, 2**63, 300_000).astype(np.uint64)))
    assert len(point(packed)) > TREE_GROUPS and folded(point(packed).astype(np.int32), TREE_GROUPS).shape == (TREE_GROUPS,)
    assert folded(point(packed).astype(np.int32), TREE_GROUPS).sum() == 300_000
