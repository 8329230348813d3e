import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from stowage.llm import bottom_k
from tests.llm.helpers import ODD, docs


def by_hand(rows):
    """The contract, all pairs: rows of (doc_id, text)."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                top[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    component = [min((x for x in ids[find(i)] if x is not None), default=None) if s else rows[i][0] for i, s in enumerate(sets)]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, component, strict=True)), key=str)


def found(spark, rows, **options):
    got = bottom_k.near_copies(docs(spark, [t for _, t in rows], [d for d, _ in rows]).repartition(3), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def edited(rng, words, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def made(seed, families, size, longest):
    rng, rows = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, longest))]
        rows += [edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08])) for _ in range(rng.randrange(1, size))]
    rng.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,longest", [(1, 60), (2, 900)])
def test_components_are_those_of_all_pairs(spark, seed, longest):
    rows = made(seed, 25, 7, longest)
    assert found(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("hot,block", [(4, 5), (20, 50)])
def test_a_hot_group_and_a_passage_that_most_documents_share(spark, hot, block):
    rng = random.Random(3)
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(150)]
    rows = [" ".join(passage) + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 13, 40]))) for _ in range(60)]
    rows += [edited(rng, base, rng.choice([0.01, 0.04])) for _ in range(60)] + [" ".join(base)] * 20
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert found(spark, rows, hot=hot, block=block) == by_hand(rows)


def test_links_across_components_of_one_list(spark):
    """A chain of texts, each a link of the next only, in one list by size: neighbours in it need not be links."""
    words = [f"c{i}" for i in range(240)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 90])) for i in range(50)]
    random.Random(4).shuffle(rows)
    assert found(spark, rows, hot=6, block=7) == by_hand(rows)


def test_awkward_rows(spark):
    rows = list(enumerate(ODD)) + [(None, "a b c d e f"), (None, "A b c  d e f"), (3, "same words here now then"), (3, "same words here now then"), (None, ""), (None, None), (50, "a b c d e f g"), (None, "only without ids at all")]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, []) == []


def test_the_estimate_keeps_all_that_link_and_few_others():
    rng, kept = np.random.default_rng(5), 0
    for n in (100, 128, 129, 150, 400, 3000):
        for _ in range(60):
            union = rng.integers(0, 2**63, int(n / 0.9), dtype=np.uint64)
            size = int(0.9 * len(union)) + 1
            a, b = np.sort(union[:size]), np.sort(union[-size:])
            assert bottom_k.linked(len(np.intersect1d(a, b)), len(a), len(b)) and bottom_k.may_link(a[: bottom_k.K], b[: bottom_k.K], len(a), len(b))
            half = np.sort(np.concatenate([a[::3], rng.integers(0, 2**63, len(a) - len(a[::3]), dtype=np.uint64)]))
            kept += bottom_k.may_link(a[: bottom_k.K], half[: bottom_k.K], len(a), len(half))
    assert kept == 0


@pytest.mark.parametrize("common,pairs", [(50, 0), (51, 19)])
def test_short_sets_that_miss_by_one_shingle_give_no_pairs_to_verify(common, pairs):
    """Twenty texts of one opening and six words of their own: 47 shingles of 59 are too few to link, 48 of 60 are enough."""
    texts = [" ".join([f"w{i}" for i in range(common)] + [f"own{k}x{i}" for i in range(6)]) for k in range(20)]
    whole = next(bottom_k._full_sets(iter([pd.DataFrame({"node": range(20), "text": texts})])))
    rows = [(r.node, r.node, r.n, r.set, np.array([1])) for r in whole.itertuples()]
    assert len(bottom_k._search_cell(1, [rows, []], True)) == pairs


def test_halves_of_hashes_never_hide_a_shared_one():
    a = np.array([1 << 32, (1 << 32) + 5, 7 << 32], np.uint64)
    assert bottom_k.shared_of(a, a) == (3, 0)
    assert bottom_k.shared_of(bottom_k._upper(a), a)[0] >= 3
    large = np.arange(20_000, dtype=np.uint32)
    assert bottom_k.shared_of(large[:100], large[50:150])[1] < 3 < bottom_k.shared_of(large, large)[1]


def test_the_query_is_its_sql(spark):
    from stowage.llm.registry import QUERIES, SQL

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    twin = con.sql(SQL["op13_minhash_near_dedup"])
    got = QUERIES["op13_minhash_near_dedup"](spark, "/root/testdata/sf0.001").select(*twin.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, twin.fetchall()))
