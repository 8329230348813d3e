import hashlib
import re

import numpy as np
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm.pii import KINDS, base_spans, find_pii, listed, luhn
from stowage.llm.registry import QUERIES

from .helpers import ODD, docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern.replace(r"[\x20-]?", "[ -]?").replace(r"\x20", " "), text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a0149@.+-() %\n", max_size=40) | st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1.9", "a@b.c", "@", ".", "+1 (555) 010-9999", "x", " ", "9"]), max_size=8).map("".join))
def test_base_spans_are_the_patterns_matches(text):
    assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1.1" * 60_000, "a@" * 60_000, "+" + "(" * 200_000):
        base_spans(text)


def test_query_against_brute_force(spark, sf, duck):
    texts = dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())
    for r in QUERIES["op1_pii"](spark, sf).collect():
        spans = brute(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(told.split(",")) <= set(r.spans.split(","))


def test_patterns_discover_unprefixed_numbers(spark):
    known = [f"Please ring phone number +1 (212) 555-01{i:02d} today" for i in range(12)]
    fresh = ["Please ring phone number 212-555-0199 today", "lot code 212-555-0188 shipped"]
    rows = find_pii(docs(spark, known + fresh)).select("doc_id", listed("spans").alias("spans")).collect()
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[12] == "phone:25:37" and spans[13] == "" and spans[0].startswith("phone:25:")


def test_odd_documents(spark):
    rows = find_pii(docs(spark, [*ODD, "m a@b.co", "m a@b.co"], [*range(len(ODD)), None, None])).select("doc_id", listed("spans").alias("s")).collect()
    assert len(rows) == len(ODD) + 2 and sorted(r.s for r in rows if r.s) == ["email:2:8"] * 2
    assert find_pii(docs(spark, [])).count() == 0


def test_planted_identifiers(spark):
    """Precision and recall of what the contexts add, over identifiers in contexts that seeds vouch for and look-alikes in others."""
    rng = np.random.default_rng(1)
    frames = ["Phone: {}", "my mobile number {} thanks", "Please contact us under {} soon", "ring (office): {} or"]
    noise = ["part no {} in stock", "lot {} shipped", "see chapter {} below", "serial: {}"]
    number = lambda: f"{rng.integers(200, 999)}-{rng.integers(200, 999)}-{rng.integers(1000, 9999)}"
    seeds = [frames[i % 4].format("+1 " + number()) for i in range(60)]
    planted, decoys = [frames[i % 4].format(number()) for i in range(80)], [noise[i % 4].format(number()) for i in range(80)]
    rows = find_pii(docs(spark, seeds + planted + decoys)).select("doc_id", listed("spans").alias("s")).collect()
    caught = sum("phone:" in r.s for r in rows if 60 <= r.doc_id < 140)
    false = sum(r.s != "" for r in rows if r.doc_id >= 140)
    assert caught >= 76 and false == 0


def test_secrets_are_learned_from_slots(spark):
    rng = np.random.default_rng(2)
    text = lambda n, of="0123456789abcdef": "".join(rng.choice(list(of), n))
    keys = [f'set token = "{text(40)}" now' for _ in range(12)]
    fresh = ['set token = "' + text(12, "abcdefghij0123456789") + 'z9"', f"use password={text(18)} here", "password=letters", "token = 12345678", "height: 1234abcd cm", "AKIA" + text(16, "ABCDEFGH2345")]
    rows = {r.doc_id: r.s for r in find_pii(docs(spark, keys + fresh)).select("doc_id", listed("spans").alias("s")).collect()}
    assert all(rows[i].startswith("secret:13:53") for i in range(12))
    assert rows[12] == "secret:13:27" and rows[13] == "secret:13:31" and rows[17] == "secret:0:20" and rows[14] == rows[15] == rows[16] == ""


def test_a_confirmed_entity_counts_without_context(spark):
    known = [f"Please ring phone number +1 (212) 555-01{i:02d} today" for i in range(12)]
    rows = {r.doc_id: r.s for r in find_pii(docs(spark, [*known, "Please ring phone number 212-555-0199 today", "212-555-0199", "jane at example.com"])).select("doc_id", listed("spans").alias("s")).collect()}
    assert rows[13] == "phone:0:12" and rows[14] == ""


def test_learned_are_unknown_instances_only(spark):
    rng = np.random.default_rng(4)
    text = lambda n, of="0123456789abcdef": "".join(rng.choice(list(of), n))
    keys = [f'set token = "{text(40)}" now' for _ in range(12)] + ["AKIA" + text(16, "ABCDEFGH2345")] * 3
    found = find_pii(docs(spark, [*keys, f'set token = "{text(12)}z9" now', "a@b.co"])).select("doc_id", F.size("spans").alias("n"), F.size("learned").alias("learned"), F.size("base").alias("base")).collect()
    got = {r.doc_id: (r.n, r.learned, r.base) for r in found}
    assert all(got[k] == (1, 0, 0) for k in range(15)) and got[15] == (1, 1, 0) and got[16] == (1, 0, 1)


def test_what_is_learned_on_the_table(spark):
    rows = QUERIES["op1_pii"](spark, "/root/testdata/sf0.1").collect()
    base = lambda r: r.n_email + r.n_ip + r.n_card + r.n_phone
    assert all(r.n_found >= base(r) + r.n_learned for r in rows)
    assert 0 < sum(r.n_learned for r in rows) < sum(r.n_found - base(r) for r in rows)
