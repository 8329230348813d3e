import hashlib

import numpy as np

from stowage.llm.merkle import Tree, edited, fingerprint_documents, first_difference, likeness, pieces_of
from stowage.llm.registry import QUERIES

from .helpers import ODD, docs


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(order)
    by_id = {r.doc_id: r for r in got}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        change = edited(text, after)
        r, a, b = by_id[i], Tree(text), Tree(change)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(change.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.root, b.root)
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, Tree(after)))


def test_against_brute_force(spark):
    check([(i, t or "") for i, t in enumerate(ODD)], fingerprint_documents(docs(spark, ODD), 7).collect())
    check([(i, t or "") for i, t in enumerate(ODD)], fingerprint_documents(docs(spark, ODD), 1).collect())


def test_sparse_ids_single_and_empty(spark):
    ids = [10**12, -5, None, 7, 8, 2**40]
    texts = ["one. two. three.", "b\n\nc", "null id", "d e f", "", "z"]
    check(list(zip(ids, texts, strict=True)), fingerprint_documents(docs(spark, texts, ids), 4).collect())
    check([(3, "alone here")], fingerprint_documents(docs(spark, ["alone here"], [3]), 4).collect())
    assert fingerprint_documents(docs(spark, []), 4).count() == 0


def test_query_over_the_table(spark, sf, duck):
    check(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall(), QUERIES["op3_merkle"](spark, sf).collect())


def test_branches_locate_edits():
    a = Tree("one.\ntwo.\n\nthree.\nfour. five.")
    b = Tree("one.\ntwo.\n\nthree.\nfour. six.")
    assert first_difference(a, b) == (2, 1) and 0.5 < likeness(a, b) < 1 and first_difference(a, Tree("one.\ntwo.\n\nthree.\nfour. five.")) is None
    assert likeness(a, Tree("nothing in common")) == 0 and likeness(Tree(""), Tree("")) == 1 and likeness(Tree(""), Tree("x")) == 0
    assert likeness(Tree("\n"), Tree("\n\n\n")) <= 1


def test_an_inserted_character_keeps_the_likeness():
    """Anywhere in one long line without sentence ends, and in a run without spaces."""
    rng = np.random.default_rng(0)
    line = " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(300))
    for text in (line, line.replace(" ", "")):
        for at in (0, 1, len(text) // 3, len(text) // 2, len(text)):
            changed = text[:at] + "Z" + text[at:]
            assert 0.9 < likeness(Tree(text), Tree(changed)) < 1
        assert likeness(Tree(text), Tree("Y" + text[::-1])) < 0.1
    assert "".join(pieces_of(line)) == line and max(map(len, pieces_of(line))) < 600
    assert likeness(Tree("a" * 5000), Tree("a" * 5000 + "b")) >= 0


def test_many_rows_without_an_id(spark):
    texts = [f"text {i}. more {i * i}" for i in range(60)]
    rows = fingerprint_documents(docs(spark, texts, [None] * 50 + list(range(10))), 8).collect()
    assert len(rows) == 60 and sorted(r.fingerprint for r in rows) == sorted(Tree(t).root for t in texts)
    assert {r.edited_fingerprint for r in rows} <= {Tree(edited(a, b)).root for a in texts for b in texts}
