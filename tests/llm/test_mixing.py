from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm.mixing import mix, mixed_documents, period_schedule, phases, whole_weights

from stowage.llm.registry import QUERIES

from .helpers import ODD, docs
from .schedules import brute_schedule_of


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.floats(0.01, 100), min_size=1, max_size=9), st.integers(20, 200))
def test_a_period_keeps_every_share_within_one_block(targets, period):
    slots = whole_weights(targets, period)
    order, total = period_schedule(slots), sum(slots.values())
    assert total == max(period, 4 * len(targets))
    had = dict.fromkeys(slots, 0)
    for t, (s, k) in enumerate(order, 1):
        assert k == had[s]
        had[s] += 1
        assert all(abs(had[x] * total - slots[x] * t) < total for x in slots)
    assert had == slots


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 300), min_size=1, max_size=6), st.integers(5, 60))
def test_phases_place_every_block_once_in_order(blocks, period):
    targets = {s: 1.0 + i for i, s in enumerate(blocks)}
    plan, places = phases(blocks, targets, period)
    where = {(s, f, k): t for s, f, k, t in places}
    slots = {}
    for s, f, first, stop, share, length, base in plan:
        for j in range(first, stop):
            slots[s, j] = base + (j - first) // share * length + where[s, f, (j - first) % share]
    assert sorted(slots.values()) == list(range(sum(blocks.values())))
    assert all(slots[s, j] < slots[s, j + 1] for s, j in slots if (s, j + 1) in slots)


@pytest.mark.parametrize("targets", [None, {"a": 5.0, "b": 1.0}])
def test_every_row_has_one_place_and_shares_hold(spark, targets):
    sources = ["a"] * 700 + ["b"] * 300 + [None] * 40 + ["c"]
    rows = mix(docs(spark, ["t"] * len(sources), sources=sources), targets, block_rows=4).collect()
    assert len(rows) == len(sources) and len({(r.slot, r.place) for r in rows}) == len(sources)
    for s in set(sources):
        own = sorted((r.rank, r.slot, r.place) for r in rows if r.source == s)
        assert [x[0] for x in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1:])
    if targets:
        weights = whole_weights({"a": 5.0, "b": 1.0, None: 3.0, "c": 3.0})
        slots = {r.slot: r.source for r in rows}
        had, total = dict.fromkeys(weights, 0), sum(weights.values())
        for t in range(1, 5):  # until the first source is used up
            had[slots[t - 1]] += 1
            if had["c"] > 0:
                break
            assert all(abs(had[s] - weights[s] * t / total) < 1 for s in weights)


def test_same_seed_same_order_other_seed_other_order(spark):
    df = docs(spark, ["t"] * 200)
    order = lambda seed: [r.doc_id for r in mix(df, seed=seed).orderBy("slot", "place").collect()]
    assert order(1) == order(1) != order(2)


def test_documents_keep_their_columns(spark):
    df = docs(spark, ODD, [0, 0, None, None, 4, 5, 6, 7, 8, 9], sources=[None, "a"] * 5)
    out = mixed_documents(df, block_rows=1)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert mixed_documents(docs(spark, [])).count() == 0


def test_order_is_the_schedule(spark):
    df = docs(spark, ["t"] * 300, sources=np.random.default_rng(0).choice(["a", "b", "c"], 300, p=[0.6, 0.3, 0.1]).tolist())
    want = [r.doc_id for r in mix(df, block_rows=8).orderBy("slot", "place").collect()]
    assert [r.doc_id for r in mixed_documents(df, block_rows=8).collect()] == want


@pytest.mark.parametrize("targets", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.999, "b": 0.001}, {"a": 7, "b": 2, "c": 1.5, "d": 1}])
def test_shares_are_of_the_targets_themselves(targets):
    blocks = {s: round(4000 * w / sum(targets.values())) for s, w in targets.items()}
    plan, places = phases(blocks, targets)
    where = {(s, f, k): t for s, f, k, t in places}
    slots = sorted((base + (j - first) // share * length + where[s, f, (j - first) % share], s) for s, f, first, stop, share, length, base in plan for j in range(first, stop))
    had = dict.fromkeys(targets, 0)
    for t, (_, s) in enumerate(slots, 1):
        had[s] += 1
        if had[s] == blocks[s]:
            break
        assert all(abs(had[x] - t * Fraction(str(targets[x])) / sum(Fraction(str(w)) for w in targets.values())) < 1 for x in targets)


def test_many_sources(spark):
    sources = [f"s{i % 700}" for i in range(2100)] + ["big"] * 500
    rows = mix(docs(spark, ["t"] * len(sources), sources=sources), block_rows=2).collect()
    assert len(rows) == len(sources) and len({(r.slot, r.place) for r in rows}) == len(sources)
    assert {r.slot for r in rows} == set(range(len({(r.source, r.block) for r in rows})))


def test_query_against_a_brute_force_schedule(spark, sf):
    """Every row of the table, against a schedule that walks through all slots."""
    got = {r.doc_id: (r.slot, r.place) for r in QUERIES["op8_mixing"](spark, sf).collect()}
    assert got == brute_schedule_of(spark, sf, set(got))
