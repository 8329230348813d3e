import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stowage.llm import collocations
from stowage.llm.collocations import mine_collocations
from stowage.llm.common import release
from tests.llm.helpers import ODD, SCHEMA


def by_hand(rows, least=10, top=2000):
    """The contract, word by word: rows of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, "s", 0, 0.5, "r", "b") for i, (lang, t) in enumerate(rows)], SCHEMA)
    got = mine_collocations(df.repartition(3), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def made(seed, n, words, hot=""):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "Ab", "aB"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", hot]) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("seed,words,segment,ranges", [(1, 6, 2_000_000, None), (2, 12, 50, 40), (3, 4, 7, 200), (4, 30, 300, 3)])
def test_counts_scores_and_order_are_those_by_hand(spark, monkeypatch, seed, words, segment, ranges):
    monkeypatch.setattr(collocations, "SAMPLE_EVERY", 3)  # cuts inside words and pairs
    rows = made(seed, 200, words)
    assert mined(spark, rows, segment=segment, ranges=ranges) == by_hand(rows)


def test_a_hot_pair_is_cut_through(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLE_EVERY", 2)
    rows = made(5, 150, 40, hot=" of the ")
    rows += [("en", " ".join(f"of the x{i}" for i in range(k, k + 30))) for k in range(0, 600, 10)]
    assert mined(spark, rows, segment=400, ranges=64) == by_hand(rows)


def test_awkward_rows(spark):
    rows = [(None, t) for t in ODD] + [("", "a b. a b"), ("x\ty", "a b " * 12), ("de", None), ("fr", "...,,; ?!"), ("en", "Same Same " * 11)] * 2
    assert mined(spark, rows) == by_hand(rows)


def test_fewer_phrases_than_asked_for_and_an_empty_table(spark):
    rows = made(6, 120, 5)
    assert mined(spark, rows, top=3) == by_hand(rows, top=3)
    assert mined(spark, rows, least=10**6) == []
    assert mined(spark, []) == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**13
    df = spark.range(1).selectExpr(f"{big}L + 7 as a", f"{big}L + 9 as l", f"{big}L + 8 as r")
    assert df.select(collocations._score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 * (big + 7) ** 2 // ((big + 9) * (big + 8))


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    rows = made(7, 80, 8)
    honest = collocations.word_hash
    shards = collocations._shards

    def clashing(seed, segment):  # the first seed has 16 hashes in all
        run = shards(seed, segment)
        if seed:
            return run

        def patched(batches):
            collocations.word_hash = lambda lang, word, s: honest(lang, word, s) % 16 + 1
            try:
                yield from run(batches)
            finally:
                collocations.word_hash = honest

        return patched

    monkeypatch.setattr(collocations, "_shards", clashing)
    assert mined(spark, rows) == by_hand(rows)


def test_paths_of_a_shard_add_up():
    numbers = np.array([1, 2, 1, 2, 0, 2, 1, 0], np.int32)
    keys, counts = collocations._paths(numbers, len(numbers), np.array([0, 1, 2], np.uint64))
    a, b, c = collocations._unpacked(keys)
    assert list(zip(a.tolist(), b.tolist(), c.tolist(), counts.tolist(), strict=True)) == [(1, 0, 0, 1), (1, 2, 0, 1), (1, 2, 1, 1), (2, 0, 0, 1), (2, 1, 0, 1), (2, 1, 2, 1)]


def test_the_query_is_its_sql(spark, sf, duck):
    from stowage.llm.registry import QUERIES, SQL
    from tests.conftest import canonical

    sf = sf.replace("sf0.001", "sf0.01")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert canonical(QUERIES["op11_collocations"](spark, sf).toPandas()) == canonical(con.sql(SQL["op11_collocations"]).df())
    release(spark)
