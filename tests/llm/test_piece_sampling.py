import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from stowage.llm.piece_sampling import SPACE, Pieces, decode_segmentations, log_inclusion, public_model, sample_segmentations, sample_texts, units_of

from stowage.llm.registry import QUERIES

from .helpers import ODD, docs

T = 4000.0


@pytest.fixture(scope="module")
def pieces():
    return Pieces(public_model())


def paths(text, pieces):
    """Every segmentation of a text with its probability, by listing them all."""

    def unit_paths(u):
        out = []

        def go(i, ids, score):
            if i == len(u):
                out.append((tuple(ids), score))
                return
            for j in range(i + 1, len(u) + 1):
                k = pieces.ids.get(u[i:j])
                if k is not None:
                    go(j, [*ids, k], score + pieces.score[k] / T)
            if u[i] not in pieces.ids:
                go(i + 1, [*ids, *(pieces.byte[b] for b in u[i].encode())], score + 4 * pieces.low / T)

        go(0, [], 0.0)
        z = math.log(sum(math.exp(s) for _, s in out))
        return [(ids, s - z) for ids, s in out]

    whole = [((), 0.0)]
    for u in units_of(text):
        whole = [(a + b, x + y) for a, x in whole for b, y in unit_paths(u)]
    return {ids: math.exp(s) for ids, s in whole}


def sampled(text, keys, pieces, k):
    out = {}
    for s in sample_texts([text] * len(keys), np.array(keys), pieces, k, T):
        ends = np.cumsum(s["counts"])
        for i, row in enumerate(s["row"]):
            out.setdefault(int(row), []).append((tuple(s["ids"][ends[i] - s["counts"][i] : ends[i]].tolist()), s["log_p"][i], s["value"][i], s["kappa"][i]))
    return out


def test_samples_follow_sampling_without_replacement(pieces):
    text = "to it"
    p = paths(text, pieces)
    n, k = 6000, 3
    got = sampled(text, range(n), pieces, k)
    first, second = Counter(g[0][0] for g in got.values()), Counter(g[1][0] for g in got.values())
    want2 = Counter()
    for a in p:
        for b in p:
            if a != b:
                want2[b] += p[a] * p[b] / (1 - p[a])
    for ids in p:
        for count, q in ((first[ids], p[ids]), (second[ids], want2[ids])):
            assert abs(count - n * q) < 5 * math.sqrt(n * q * (1 - q)) + 3
    for g in got.values():
        assert len({x[0] for x in g}) == len(g) == min(k, len(p)) and [x[2] for x in g] == sorted((x[2] for x in g), reverse=True)
        assert all(abs(math.exp(x[1]) - p[x[0]]) < 1e-9 and x[3] <= x[2] for x in g)


def test_inclusion_scores_are_unbiased(pieces):
    text = "to it"
    p = paths(text, pieces)
    got = sampled(text, range(4000), pieces, 2)
    total = np.mean([sum(math.exp(lp) / math.exp(log_inclusion(np.array([lp]), np.array([kap]))[0]) for _, lp, _, kap in g) for g in got.values()])
    assert abs(total - 1) < 0.05 and abs(sum(p.values()) - 1) < 1e-9


def test_all_segmentations_come_out_when_k_allows(pieces):
    p = paths("of", pieces)
    got = sampled("of", [1, 2, 3], pieces, len(p) + 3)
    likely = {ids for ids, q in p.items() if q > 1e-10}
    assert len(likely) > 1 and all(likely <= {x[0] for x in g} <= set(p) and len({x[0] for x in g}) == len(g) for g in got.values())
    assert all(x[3] == -np.inf for x in got[0])


def test_odd_documents_round_trip(spark, pieces):
    texts = [*ODD, "  two  spaces ", "\ttab\nline x", "z" * 100, "☃\U0001f600 日本", f"real {SPACE} mark", "same", "same"]
    ids = [*range(len(texts) - 2), None, None]
    rows = sample_segmentations(docs(spark, texts, ids), k=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in zip(ids, texts, strict=True):
        own = by[i] if i is not None else [r for r in by[None]]
        if i is None:
            assert len(own) == 6 and len({tuple(r.ids) for r in own}) == 3
        elif not t:
            assert [(r.n_pieces, r.ids, r.log_prob) for r in own] == [(0, [], 0.0)]
        else:
            assert len({tuple(r.ids) for r in own}) == len(own) == 3 or not re.search("[A-Za-z]{2}", t)
        for r in own:
            assert pieces.decode(r.ids) == (t or "").replace(SPACE, " ") and r.n_pieces == len(r.ids) and r.perturbed is not None
    assert sample_segmentations(docs(spark, [])).count() == 0


def test_a_row_depends_on_its_key_alone(spark):
    a = {(r.doc_id, r.sample): r.ids for r in sample_segmentations(docs(spark, ["the same words of a text"] * 4 + ["é" * 30])).collect()}
    b = {(r.doc_id, r.sample): r.ids for r in sample_segmentations(docs(spark, ["the same words of a text"], [2])).collect()}
    assert all(a[k] == v for k, v in b.items()) and a[0, 0] != a[1, 0]


def test_own_encoding_decodes(pieces):
    for t in ("Of the people, by  the people", "", None, "日本 \U0001f600"):
        assert pieces.decode(pieces.encode(t)) == (t or "")


def test_pieces_across_any_position_come_out(pieces):
    """Over long words, the sampled probability is that of the whole word's lattice, and no position is a forced cut."""
    word = "internationalization" * 3
    cuts = set(range(1, len(word)))
    for g in sampled(word, range(400), pieces, 2).values():
        for ids, log_p, *_ in g:
            ends = set(np.cumsum([len(pieces.text[i]) for i in ids]).tolist())
            cuts -= set(range(1, len(word))) - {e - 1 for e in ends}
            assert log_p < 0
    assert not cuts  # every position lies inside a piece of some sample
    codes = units_of(word, pieces.units)
    assert codes == [SPACE + word]


def test_units_part_no_piece(pieces):
    for text in ("a\n\nb  c\td", "日本語 text", "\n" * 40, "x" * 50 + "\U0001f600" * 20):
        own = SPACE + text.replace(" ", SPACE)
        units = units_of(text, pieces.units)
        assert "".join(units) == own
        at = np.cumsum([len(u) for u in units])[:-1].tolist()
        for i in range(len(own)):
            for j in range(i + 2, min(len(own), i + 17) + 1):
                assert own[i:j] not in pieces.ids or not any(i < c < j for c in at)


def test_long_runs_without_spaces(spark, pieces):
    text = "abcdefghij" * 3000
    rows = sample_segmentations(docs(spark, [text]), k=3).collect()
    assert len({tuple(r.ids) for r in rows}) == 3 and all(pieces.decode(r.ids) == text for r in rows)


def test_decoding_on_spark(spark, pieces):
    texts = [*ODD[:6], "☃ snow \U0001f600", " lead", f"a{SPACE}b", "tab\tand\nline"]
    rows = decode_segmentations(sample_segmentations(docs(spark, texts))).collect()
    for r in rows:
        want = (texts[r.doc_id] or "").replace(SPACE, " ")
        assert r.decoded == want == pieces.decode(r.ids) and r.decoded_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_query_over_the_table(spark, sf):
    """Every document's samples are distinct, decode to its text and have the probability that their pieces give."""
    texts = {r.doc_id: (r.text or "").replace(SPACE, " ") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_sentencepiece"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
