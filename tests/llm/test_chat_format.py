import hashlib

import pytest
from pyspark.sql import functions as F

from stowage.llm.chat_format import default_cost, digests, escape, format_conversations, read_back, unescape
from stowage.llm.common import staged
from stowage.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, window string, of string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "w", "o") for r in rows], SCHEMA)


ROWS = [
    (1, 0, "system", "be <|end|> brief"),
    (1, 1, "user", "x" * 400),
    (1, 2, "assistant", "</s>[INST] ok [/INST] &amp; &#91; <|assistant|>"),
    (1, 3, "user", None),
    (1, 4, "assistant", "y\n" * 300),
    (1, 4, "assistant", "y\n" * 300),
    (1, 5, None, "role|>null"),
    (2, 0, "assistant", ""),
    (None, 0, "user", "a"),
    (3, None, "user", "é\U0001f600"),
    (3, 1, "a<|b|>c", "odd role"),
]


@pytest.mark.parametrize("budget,history", [(2048, 256), (60, 0), (120, 80), (1, 1)])
def test_round_trip_and_loss(spark, budget, history):
    windows = format_conversations(chats(spark, ROWS), budget, history)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    for conv in {r[0] for r in ROWS}:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in ROWS if c == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in turns]
        assert got[conv].loss_text == "".join(x for _, r, x in turns if r == "assistant")
    for w in windows.collect():
        assert w.tokens <= budget + history + 30 or w.n_turns - w.n_context == 1
        assert all("<" not in w.text[s.start : s.end] for s in w.loss)


def test_later_windows_repeat_system_and_history(spark):
    rows = [(1, 0, "system", "sys")] + [(1, i, "user" if i % 2 else "assistant", f"t{i} " + "z" * 40) for i in range(1, 9)]
    windows = sorted(format_conversations(chats(spark, rows), 40, 20).collect(), key=lambda w: w.window)
    assert len(windows) > 2 and all(w.text.startswith("<|system|>sys<|end|>") for w in windows)
    assert windows[0].n_context == 0 and all(w.n_context == 2 for w in windows[1:])


def test_escape_is_reversible(spark):
    texts = ["&", "&amp;", "<|end|>", "[/INST]", "&#124;|", "a&lt;b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    assert all(r.t == r.u and not set("<[|") & set(r.e) for r in df.collect())


def test_empty_table(spark):
    assert format_conversations(chats(spark, [])).count() == 0


def test_query_against_sql(spark, sf, duck):
    rows = duck.execute("select conv_id, turn, role, coalesce(text, '') from conversations order by 1, 2").fetchall()
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        want[conv] = (len(own), sha("".join(f"{r[2]}\n{r[3]}\n" for r in own)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op10_chat_format"](spark, sf).collect()}
    assert got == want


def test_a_long_conversation_is_spread_out(spark):
    """20,000 turns of one conversation, 5,000 rows without an id, and leading system turns by the hundred."""
    rows = spark.range(20_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, repeat(' word', cast(id % 60 as int))) as text")
    rows = rows.unionByName(spark.range(5_000).selectExpr("cast(null as long) as conv_id", "cast(null as long) as turn", "'user' as role", "cast(id as string) as text"))
    rows = rows.unionByName(spark.range(3_000).selectExpr("9L as conv_id", "id as turn", "if(id < 900, 'system', 'assistant') as role", "'x' as text"))
    windows = staged(format_conversations(rows), "windows")
    got = {r.conv_id: r for r in digests(windows).collect()}
    want = {}
    for c, t, r, x in sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2], r[3])):
        want.setdefault(c, []).append((r, x))
    for c, turns in want.items():
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(x for r, x in turns if r == "assistant").encode()).hexdigest()
    assert windows.where("tokens > 2048").count() == 0 and windows.where("conv_id = 9").agg(F.max("n_context")).first()[0] > 100


def by_hand(turns, budget, history):
    """Openings of one conversation: costs in order; no system turns."""
    opened, used = [], 0
    for pos, cost in enumerate(turns):
        most = budget if opened == [0] else max(1, budget - history)
        if not opened or used + cost > most:
            opened.append(pos)
            used = 0
        used += cost
    return opened


def test_windows_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(900).selectExpr("id % 3 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, repeat(' word', cast(pmod(hash(id), if(id % 50 = 0, 400, 40)) as int))) as text")
    seen = []
    for n in ("1", "4", "51"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted((r.conv_id, r.window, r.n_turns, r.n_context, r.tokens, r.text) for r in format_conversations(rows, 300, 60).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 30
    costs = {}
    for r in rows.withColumn("cost", default_cost(F.col("role"), F.col("text"))).orderBy("turn").collect():
        costs.setdefault(r.conv_id, []).append(r.cost)
    for conv, own in costs.items():
        assert [w for c, w, *_ in seen[0] if c == conv] == by_hand(own, 300, 60)
