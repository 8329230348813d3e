import re

import corpus_pipeline as p

from stowage.llm import toxicity
from stowage.llm.common import table
from stowage.llm.piece_sampling import Pieces, public_model

from .helpers import ODD, docs
from .schedules import brute_schedule_of
from .test_exact_dedup import brute as exact_brute
from .test_ngram_join import brute as near_brute


def test_stages_against_brute_force(spark, sf):
    rows = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    model = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    kept = {i: t for i, t in rows.items() if model.scores([t])[0] < toxicity.THRESHOLD}
    assert 0 < len(kept) < len(rows)
    exact = exact_brute(kept.items())
    kept = {i: t for i, t in kept.items() if exact[i][2]}
    near = near_brute(list(kept.items()))
    kept = {i: t for i, t in kept.items() if near[i][1] == i}
    out = p.run(spark, sf).collect()
    pieces = Pieces(public_model())
    assert {r.doc_id for r in out} == set(kept) and len({(r.doc_id, r.sample) for r in out}) == len(out)
    for r in out:
        assert pieces.decode(r.ids) == kept[r.doc_id]


def test_each_stage_keeps_the_columns_and_survives_odd_rows(spark, sf):
    df = docs(spark, [*ODD, "a", None], [*range(len(ODD)), 3, None])
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns and out.count() <= df.count()
        empty = stage(spark, df.limit(0), sf)
        assert empty.columns == df.columns and empty.count() == 0
    assert p.STAGES[-1][1](spark, df, sf).count() > 0


def test_exact_stage_keeps_one_of_repeated_rows(spark, sf):
    df = docs(spark, ["x y", "x y", "xy ", "z"], [1, 1, 2, None])
    out = p.exact_dedup_stage(spark, df, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "z"), (1, "x y")]


def test_stage_order():
    assert [re.sub("_.*", "", n) for n, _ in p.STAGES] == ["toxicity", "exact", "ngram", "mixing", "sentencepiece"]


def test_rows_carry_the_schedule_through_storage(spark, sf):
    stored = p.run(spark, sf)
    got = {(r.doc_id, r.sample): (r.slot, r.place) for r in stored.select("doc_id", "sample", "slot", "place").collect()}
    kept = {i for i, _ in got}
    want = brute_schedule_of(spark, sf, kept)
    assert {i: got[i, 0] for i in kept} == want
    assert all(place == want[i] for (i, _), place in got.items())
