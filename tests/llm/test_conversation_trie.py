import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import types as T

from stowage.llm import conversation_trie as trie
from tests.llm.helpers import LONG

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("part", T.StringType()), T.StructField("depth", T.LongType())])


def by_hand(rows):
    """The contract: rows of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(None if c is None else c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    members[()] += []
    least = lambda p: min((c for c in members[p] if c is not None), default=None)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(re.findall(r"[^ \t-\r]+", p[-1][1])) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[p] if c is not None and len(whole[c]) == len(p))).encode()).hexdigest()
    return sorted((str(least(p)), len(p), str(least(p[:-1]) if p else None), len(cs), children[p], leaves[p], saved[p], ends(p)) for p, cs in members.items())


def rolled(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(parts)
    got = trie.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((str(r[0]), r[1], str(r[2]), *r[3:]) for r in got.collect())


def made(seed, n, turns, texts):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"{rng.randrange(texts)} word " * rng.randrange(3)) for c in rng.sample(range(-15, 3 * n), n) if c >= 0 for t in range(rng.randrange(1, turns))]
    return [*rows, *[(c, 0, "user", "only turn") for c in range(400, 440)]]


@pytest.mark.parametrize("seed,n,turns,texts", [(1, 60, 6, 2), (2, 30, 20, 1), (3, 100, 4, 3)])
def test_nodes_and_sums_are_those_by_hand(spark, seed, n, turns, texts):
    rows = made(seed, n, turns, texts)
    assert rolled(spark, rows) == by_hand(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, None, "a b"), (None, None, "user", None), (7, None, "user", "x"), (7, None, "user", "x"), (7, 1, "b", LONG), (7, 1, "a", LONG), (40, 0, "", ""), (41, 0, None, None), (1 << 40, 3, "u", "é\U0001f600  y\n")]
    assert rolled(spark, rows) == by_hand(rows)
    assert rolled(spark, rows + rows) == by_hand(rows + rows)


def test_only_rows_without_a_conversation_and_an_empty_table(spark):
    rows = [(None, 1, "user", "a b"), (None, 2, "user", "c")]
    assert rolled(spark, rows) == by_hand(rows)
    assert rolled(spark, []) == by_hand([])


def test_a_conversation_that_holds_most_turns_is_spread_and_rolled_up_in_logarithmic_rounds(spark, monkeypatch):
    rounds, real = [], trie.staged
    monkeypatch.setattr(trie, "staged", lambda df, name: (rounds.append(name), real(df, name))[1])
    rows = [(0, t, "user", f"turn {t}") for t in range(300)] + [(20 * c, t, "user", f"turn {t}") for c in range(1, 9) for t in range(40)]
    assert rolled(spark, rows) == by_hand(rows)
    assert rounds.count("conversation-round") == 9
    turns = trie._numbered(spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA))
    assert turns.where("id = 0").select("part").distinct().count() > 3


def test_a_list_of_members_of_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(trie, "FRAGMENT", 3)
    rows = [(20 * c, 0, "user", "same") for c in range(50)] + [(20 * c + 1, t, "user", "same") for c in range(9) for t in range(2)]
    assert rolled(spark, rows) == by_hand(rows)


def test_the_query_is_its_sql(spark):
    from stowage.llm.registry import QUERIES, SQL

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    twin = con.sql(SQL["op12_conversation_trie"])
    got = QUERIES["op12_conversation_trie"](spark, "/root/testdata/sf0.01").select(*twin.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, twin.fetchall()))
