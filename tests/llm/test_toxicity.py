import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import toxicity
from stowage.llm.registry import QUERIES
from stowage.llm.toxicity import LONG_WORD, PRIOR, FuzzyLexicon, ToxicityModel

from .helpers import ODD, docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_the_edit_distance():
    terms = ["moron", "idiot", "stupid", "clown", "aaaaa"]
    lexicon = FuzzyLexicon(terms)
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("adimnorstpuclw"), rng.integers(0, 8))) for _ in range(3000)]
    for t in terms:
        for _ in range(200):
            w, i = list(t), rng.integers(0, len(t))
            w[i : i + rng.integers(0, 2)] = list(rng.choice(list("adixz"), rng.integers(0, 2)))
            words.append("".join(w))
    for w in words:
        best = min(distance(w, t) for t in terms)
        assert lexicon.edits(w) == (best if best <= 1 else None), w


def test_misspelled_quoted_and_plain():
    m = ToxicityModel(["moron", "stupid"], ["vequ"], PRIOR)
    plain, fuzzy, stem, quoted, clean, none = m.scores(["you moron", "you m0ron and stuupid", "la vequaire est", 'he said: "you moron" and left', "a fine day", None])
    assert min(plain, fuzzy, stem) >= 0.7 > max(quoted, clean) and clean == none and quoted > clean


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_odd_documents_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, ODD), labels)
    rows = toxicity.score_documents(docs(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1 and not any(r.predicted for r in rows)
    assert toxicity.score_documents(docs(spark, []), model).count() == 0
    assert toxicity.drop_toxic(docs(spark, ODD), model).columns == docs(spark, ODD).columns
    bad = spark.createDataFrame([(0, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    toxicity.fit(docs(spark, ODD), bad)


def test_split_is_by_checksum(spark):
    import zlib

    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_fitted_model_catches_misspellings(spark):
    sf = "/root/testdata/sf0.01"
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    bad = model.scores(["what a moroon he is", "the idi0t came", 'she wrote: "what a moron" in it'])
    assert bad[0] >= 0.7 and bad[1] >= 0.7 and bad[2] < 0.7 and model.scores(["a fine morning"])[0] < 0.2


def test_every_term_is_found_misspelled_at_any_letter():
    m = ToxicityModel(["moron", "scum", "idiot"], ["vequ"], PRIOR, ["diet"])
    bad = ["an xdiot", "a diot", "such skum", "oron", "la vxquaire est", "la equaire est"]
    assert min(m.scores(bad)) >= 0.7 > max(m.scores(["a diet", "a verb", "fine"]))


def test_near_terms_are_those_within_the_distance():
    words, stems = ["moron", "idiot", "aaaaa", "scum"], ["vequ", "moro", "stup"]
    lexicon = FuzzyLexicon([*words, *(f"{s}-" for s in stems)])
    rng = np.random.default_rng(1)
    for _ in range(3000):
        w = list(rng.choice([*words, *stems])) + list(rng.choice(list("aeqx"), rng.integers(0, 3)))
        i = rng.integers(0, len(w))
        w[i : i + rng.integers(0, 3)] = list(rng.choice(list("adixz"), rng.integers(0, 2)))
        w = "".join(w)
        starts = {s for s in stems if len(w) >= len(s) and min(distance(w[:n], s) for n in range(len(w) + 1)) <= 1}
        assert lexicon.near(w) == {t for t in words if distance(w, t) <= 1} | {f"{s}-" for s in starts}, w


def test_rare_terms_misspelled_after_fit(spark):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]
    word = {i: ("blarghed" if n < 60 else "snurfled" if n < 68 else "pleasant") for n, i in enumerate(ids)}
    texts = [f"{word[i]} n{i} and m{i * 7} o{i * 13}" for i in ids]
    labels = spark.createDataFrame([(i, int(word[i] != "pleasant")) for i in ids], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, texts, ids), labels)
    assert min(model.scores(["xnurfled", "snurfed", "blarghd"])) >= 0.7 > max(model.scores(["pleasant", "pleasent"]))


def test_long_words_are_found_with_two_misspellings():
    terms = ["blatherskite", "moron", "ignoramus"]
    lexicon = FuzzyLexicon(terms)
    rng = np.random.default_rng(4)
    words = ["blaterskte", "blatherskit", "xlathersktie", "mroan", "ignoramux", "ignromaus", "morons", "ignoramuses"]
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                i = rng.integers(0, len(w))
                w[i : i + rng.integers(0, 2)] = list(rng.choice(list("abioz"), rng.integers(0, 2)))
            words.append("".join(w))
    for w in words:
        near = {t for t in terms if distance(w, t) <= 1 + (len(t) >= LONG_WORD)}
        assert lexicon.near(w) == near and lexicon.edits(w) == min((distance(w, t) for t in near), default=None), w


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.75), ("sf0.1", 0.9)])
def test_held_out_recall(spark, sf, least):
    """At sf0.01 four of the 18 held-out toxic rows hold nothing that any toxic training row holds."""
    sf = f"/root/testdata/{sf}"
    rows = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= least * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)
