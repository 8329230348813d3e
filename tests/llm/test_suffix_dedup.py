import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from stowage.llm import suffix_dedup as s
from stowage.llm.registry import QUERIES

from .helpers import ODD, docs


def brute(rows):
    where = Counter()
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, raw in raws:
        for i in range(len(raw) - s.LENGTH + 1):
            where[raw[i : i + s.LENGTH]] += 1
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - s.LENGTH + 1):
            if where[raw[i : i + s.LENGTH]] > 1:
                gone[i : i + s.LENGTH] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int(np.sum(np.diff(np.r_[0, gone.astype(int), 0]) == 1))
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def same(spark, texts, ids=None):
    df = docs(spark, texts, ids)
    rows = [tuple(r) for r in s.remove_repeats(df).collect()]
    assert sorted(rows, key=str) == brute(list(zip(range(len(texts)) if ids is None else ids, texts, strict=True)))
    return rows


def word(rng, n):
    return "".join(rng.choice(list("abcdefgh é"), n))


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    passages = [word(rng, n) for n in (380, 400, 405, 430, 650, 1500)]
    texts = [t for t in ODD if not t or len(t) < 1000]
    for _ in range(60):
        parts = [word(rng, rng.integers(0, 500))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(0, len(passages))]
            cut = rng.integers(0, 40)
            parts += [p[cut:], word(rng, rng.integers(0, 300))]
        texts.append("".join(parts))
    texts += texts[20:25]
    near = list(texts[30])
    for i in rng.integers(0, max(1, len(near)), 3):
        near[i] = "Z"
    rows = same(spark, [*texts, "".join(near)])
    assert sum(r[2] for r in rows) > 5000


def test_runs_and_periods(spark):
    same(spark, ["a" * 399, "b" * 400, "c" * 401, "d" * 1500, "ab" * 700, "xyz " * 300 + "end", "q" + "the the " * 120, "abc" * 200 + "Q" + "abc" * 200, "e" * 400 + "f", "e" * 400 + "g"])


def test_same_document_and_borders(spark):
    rng = np.random.default_rng(2)
    p = word(rng, 400)
    same(spark, [p + "1" + p, p[1:], p[:-1], "x" + p[:399], p[:200], p + p])


def test_stretches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(s, "STRETCH", 512)
    p = word(rng, 900)
    for text in (p, word(rng, 300) + p + word(rng, 2000) + p):
        pieces = list(s._stretches(text))
        windows = [lo + i for lo, d in pieces for i in range(len(d) - s.LENGTH + 1)]
        assert windows == list(range(len(text.encode()) - s.LENGTH + 1))


def test_null_and_repeated_ids_and_empty(spark):
    p = word(np.random.default_rng(4), 450)
    same(spark, [p + "1", p + "1", "2" + p, None, p + "3"], [None, None, 7, 7, 7])
    assert s.remove_repeats(docs(spark, [])).count() == 0


def brute_passages(rows):
    """Maximal runs of words in PASSAGE-word strings that also stand in another document."""
    words = [(t or "").encode().split() for _, t in rows]
    where = {}
    for i, w in enumerate(words):
        for k in range(len(w) - s.PASSAGE + 1):
            where.setdefault(tuple(w[k : k + s.PASSAGE]), set()).add(rows[i])
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w) + 1, int)
        for k in range(len(w) - s.PASSAGE + 1):
            if len(where[tuple(w[k : k + s.PASSAGE])]) > 1:
                gone[k : k + s.PASSAGE] = 1
        out.append((d, int(np.sum(np.diff(np.r_[0, gone]) == 1))))
    return sorted(out, key=str)


def test_passages_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(word(rng, 4).replace(" ", "x") for _ in range(n))
    passages = [words(n) for n in (40, 50, 51, 52, 60, 75, 120)]
    texts = [None, "", words(60)]
    for i in range(80):
        p = passages[i % len(passages)].split(" ")
        cut = int(rng.integers(0, 4))
        texts.append(words(int(rng.integers(0, 40))) + " " + ("\n" if i % 2 else " ").join(p[cut:]) + "  " + words(int(rng.integers(0, 90))))
    texts.append(passages[4] + " " + words(3) + " " + passages[4])
    rows = list(zip(range(len(texts)), texts, strict=True))
    got = sorted(((r.doc_id, r.n_passages) for r in s.remove_repeats(docs(spark, texts), passages=True).collect()), key=str)
    assert got == brute_passages(rows) and 20 < sum(n > 0 for _, n in got) < 80


def chosen(texts):
    """A batch as the third pass takes it, with every run of the texts, and those runs."""
    lists = {f: [[] for _ in texts] for f in ("kind", "start", "place", "n", "run", "run2", "low", "high")}
    for kind, r in s._all_runs(pd.Series(texts)):
        for row, *values in zip(r.row, r.start, r.at - r.first, r.last - r.first + 1, *r.names(np.arange(len(r.at))), strict=True):
            for f, v in zip(lists, (kind, *values, 5, 6), strict=True):
                lists[f][row].append(int(v))
    marks = pa.array(range(100, 100 + len(texts)), pa.int64())
    columns = {"doc_id": pa.array([None, *range(1, len(texts))], pa.int64()), "mark": marks, "text": pa.array(texts)}
    return pa.RecordBatch.from_pydict(columns | {f: pa.array(x, pa.list_(pa.int32() if f in ("kind", "place", "n") else pa.int64())) for f, x in lists.items()}), lists


def test_third_pass_hashes_neighbours_together(monkeypatch):
    """Blocks and windows of all runs against slices of the texts; one hash of many runs, not one each."""
    rng = np.random.default_rng(6)
    texts = [word(rng, n) for n in (3000, 401, 0, 900, 400, 5000)] + ["", "ab c " * 500, "ééé " * 300, word(rng, 100_000)]
    monkeypatch.setattr(s, "STRETCH", 1 << 15)
    batch, lists = chosen(texts)
    made = []
    hasher = s.Hasher
    monkeypatch.setattr(s, "Hasher", lambda codes: made.append(len(codes)) or hasher(codes))
    rows = [r for b in s._refined(iter([batch.slice(1, 8), batch.slice(9), batch.slice(0, 1)])) for r in b.to_pylist()]
    runs = sum(map(len, lists["n"]))
    assert runs > 1000 and len(made) < runs / 20 and max(made) < 2 * s.TOGETHER
    got, names = Counter(), {}
    for r in rows:
        if r["kind"] == 0:
            raw = texts[r["mark"] - 100].encode()
            at = r["start"]
            core = raw[at : at + s.CORE]
            assert len(core) == s.CORE and r["doc_id"] == (r["mark"] - 100 or None)
            assert r["left"] == raw[max(0, at - s.BLOCK + 1) : at] and r["right"] == raw[at + s.CORE : at + s.CORE + s.BLOCK - 1]
            got[r["mark"] - 100, at] += 1
            assert names.setdefault((r["name"], r["name2"]), core) == core
    want, windows = Counter(), Counter()
    for i, text in enumerate(texts):
        words = text.encode().split()
        for kind, start, place, n, run in zip(*(lists[f][i] for f in ("kind", "start", "place", "n", "run")), strict=True):
            if kind == 0:
                want.update((i, start + place - s.BLOCK * b) for b in range((place - n + 1) // s.BLOCK, place // s.BLOCK + 1))
            else:
                windows.update((run, j, tuple(words[start + j : start + j + s.PASSAGE])) for j in range(n))
    assert got == want
    found = {}
    for r in (r for r in rows if r["kind"] == 1):
        assert (r["low"], r["high"], r["doc_id"], r["left"]) == (5, 6, None, None)
        found.setdefault((r["run"], r["start"]), []).append((r["name"], r["name2"]))
    assert Counter((run, j) for run, j, _ in windows.elements()) == Counter({k: len(v) for k, v in found.items()})
    same = {}
    for run, j, passage in windows:
        assert same.setdefault(passage, found[run, j][0]) == found[run, j][0]
    assert len(set(same.values())) == len(same)


def test_query_against_counted_windows(spark):
    """The registered query over 1,000 documents, against a count of all windows by 128 bits."""
    sf = "/root/testdata/sf0.01"
    raws = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    name = lambda raw, i: hashlib.blake2b(raw[i : i + s.LENGTH], digest_size=16).digest()
    names = {d: [name(raw, i) for i in range(len(raw) - s.LENGTH + 1)] for d, raw in raws.items()}
    seen, again = set(), set()
    for own in names.values():
        for x in own:
            (again if x in seen else seen).add(x)
    want = {}
    for d, raw in raws.items():
        gone = np.zeros(len(raw), bool)
        for i, x in enumerate(names[d]):
            if x in again:
                gone[i : i + s.LENGTH] = True
        want[d] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in QUERIES["op4_suffix_dedup"](spark, sf).collect()}
    assert got == want and sum(n > 0 for n, _ in want.values()) > 100


def test_query_against_brute_force(spark, sf):
    """The registered query over its whole table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op4_suffix_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages").collect()]
    assert sorted((r[:5] for r in got), key=str) == brute(rows)
    assert sorted((r[0], r[5]) for r in got) == sorted(brute_passages(rows))
