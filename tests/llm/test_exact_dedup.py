import hashlib
import re

import numpy as np

from stowage.llm.exact_dedup import CountingQuotientFilter, drop_copies, exact_dedup

from .helpers import ODD, docs


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((i, t or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for i, _ in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs(spark, ODD)).collect()}
    assert got == brute(list(enumerate(ODD)))


def test_hot_group_repeats_and_null_ids(spark):
    texts = ["hot copy"] * 300 + ["hot  copy"] * 2 + ["x", "x"]
    ids = [*range(300), 900, 901, None, None]
    rows = exact_dedup(docs(spark, texts, ids)).collect()
    hot = [r for r in rows if r.group_size == 302]
    assert len(rows) == 304 and len(hot) == 302 and {r.keep_id for r in hot} == {900} and sum(r.kept for r in hot) == 1
    assert [(r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id is None] == [(None, 2, True)] * 2


def test_empty_table(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    prints = rng.integers(-(2**63), 2**63 - 1, 500)
    parts = [rng.choice(prints, 300) for _ in range(5)]
    merged = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(*CountingQuotientFilter.of(p).to_bytes()) for p in parts])
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == dict(zip(keys.tolist(), counts.tolist(), strict=True))


def test_copies_go_from_a_table_with_columns_that_have_no_order(spark):
    rows = docs(spark, ["a b", "ab ", "a  b", "c"], [1, 2, 2, 3]).selectExpr("*", "map('k', doc_id) as tags")
    assert sorted((r.doc_id, r.text, r.tags["k"]) for r in drop_copies(rows).collect()) == [(2, "a  b", 2), (3, "c", 3)]
