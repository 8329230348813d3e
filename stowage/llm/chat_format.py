"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are ordered, and prefix sums of their token costs choose turn-aligned spans: a window opens at
the first turn that would pass what the budget leaves beside the context. Every later window repeats the system turns
and the last few turns before its span as context. The loss mask covers the assistant texts of a window's own span, so
a target that is repeated as context is masked there and counts once over all windows.

Turns stay rows. They are dealt out by ranges of (conversation, turn) and numbered there, so a conversation that holds a
third of all turns is spread over many tasks; counts and costs of the ranges give every turn its position and prefix
sum. Windows follow from the prefix sums alone, by pointers from each turn to the opening after it, so they don't depend on
how the turns are dealt out. A window meets its history through cells of the prefix sum, so no conversation is ever
gathered for it.

Template: ``<|role|>text<|end|>`` for each turn. Inside roles and texts ``& < [ |`` are written as entities, so no
control string of this template, nor of those that use ``</s>`` or ``[INST]``, can stand in a text; reading reverses it.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows have one order; a turn that costs more than its window's room has a window of its own, whole; leading
system turns beyond the first are repeated while they fit into half the budget; a first system turn that passes the
budget is repeated whole nevertheless; rows with a null conv_id are one conversation; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.common import staged

BUDGET = 2048
HISTORY = 256
#: Width of the cells of the prefix sum that openings are looked up by.
CELL = 128
#: What a turn's markers cost.
MARKER_TOKENS = 4
#: A token: up to four letters, up to three digits, or one other character that isn't white space.
TOKEN = r"\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
#: What is written for each escaped character, in the order of escaping.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
#: Code points of a text that the ranges are cut by.
_RANGE_CHARS = 64
_CONV = ["nil", "id"]


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ENTITIES), c)


def default_cost(role: Column, text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + MARKER_TOKENS


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), escape(turn["role"]), F.lit("|>"), escape(turn["text"]), F.lit("<|end|>"))


def _ranged(conversations: DataFrame, cost) -> DataFrame:
    """The turns in order: nil, id (the conversation), role, text, cost (1 at least), part and nth: the range and the place in it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col("conv_id").isNull().alias("nil"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"), "turn", role.alias("role"), text.alias("text"))
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = [F.col(c).asc_nulls_first() for c in (*_CONV, "turn", "role")]
    ranges = turns.repartitionByRange(tasks, *first, F.substring("text", 1, _RANGE_CHARS).asc()).sortWithinPartitions(*first, F.col("text").asc())
    numbered = ranges.withColumn("seq", F.monotonically_increasing_id())
    costs = F.greatest(cost(F.col("role"), F.col("text")).cast("long"), F.lit(1))
    return staged(numbered.select(*_CONV, "role", "text", costs.alias("cost"), F.shiftright("seq", 33).alias("part"), F.col("seq").bitwiseAND((1 << 33) - 1).alias("nth")), "chat-turns")


def _starts(turns: DataFrame) -> DataFrame:
    """Where each conversation starts in each range, with its first position and prefix sum there."""
    starts = turns.groupBy(*_CONV, "part").agg(F.min("nth").alias("base"), F.count("*").alias("n"), F.sum("cost").alias("c"))
    before = Window.partitionBy(*_CONV).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n, c = (F.coalesce(F.sum(x).over(before), F.lit(0)) for x in ("n", "c"))
    return staged(starts.select(*_CONV, "part", "base", n.alias("pos0"), c.alias("sum0")), "chat-starts")


def _heads(turns: DataFrame, starts: DataFrame, budget: int) -> DataFrame:
    """nil, id, heads (the leading system turns that are repeated), head_cost, for the conversations that have any."""
    placed = turns.join(starts.hint("merge"), [*_CONV, "part"]).withColumn("pos", F.col("pos0") + F.col("nth") - F.col("base"))
    other = placed.where("role <> 'system'").groupBy(*_CONV).agg(F.min("pos").alias("other"))
    leading = placed.where((F.col("role") == "system") & (F.col("pos") < max(budget, 1)))  # each costs a token at least
    leading = leading.join(staged(other, "chat-others").hint("merge"), _CONV, "left").where("other is null or pos < other")
    turn = F.struct("pos", "role", "text", "cost")
    fits = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used")),
        lambda s, t: F.when((s["n"] == t["pos"]) & ((s["n"] == 0) | (s["used"] + t["cost"] <= budget // 2)), F.struct((s["n"] + 1).alias("n"), (s["used"] + t["cost"]).alias("used"))).otherwise(s),
    )
    kept = leading.groupBy(*_CONV).agg(F.array_sort(F.collect_list(turn)).alias("all")).withColumn("fits", fits)
    return staged(kept.select(*_CONV, F.slice("all", 1, F.col("fits.n")).alias("heads"), F.col("fits.used").alias("head_cost")), "chat-heads")


def _openings(turns: DataFrame, budget: int) -> DataFrame:
    """nil, id, pos of the turns that open a window. turns: nil, id, pos, sum (before the turn), cost, room.

    Were a window to open at a turn, the next would open at the turn that lies across its budget's end: cells of the prefix
    sum find it for every turn at once. The openings are what the first turn reaches; pointers are doubled, so a
    conversation of a million windows takes twenty rounds, wherever ranges end.
    """
    cell = lambda c: F.floor(c / CELL)
    end = F.col("sum") + F.col("cost")
    spread = turns.select(*_CONV, "pos", "sum", end.alias("end"), F.explode(F.sequence(cell(F.col("sum")), cell(end - 1))).alias("cell"))
    asks = turns.select(*_CONV, F.col("pos").alias("at"), (F.col("sum") + F.when(F.col("pos") == 0, F.lit(budget)).otherwise(F.col("room"))).alias("most")).withColumn("cell", cell(F.col("most")))
    following = F.greatest(F.col("pos"), F.col("at") + 1)
    ahead = staged(asks.join(spread, [*_CONV, "cell"]).where("sum <= most and most < end").select(*_CONV, "at", following.alias("following")), "chat-ahead")
    opened = staged(turns.where("pos = 0").select(*_CONV, "pos"), "chat-openings")
    while True:
        reached = opened.join(ahead.withColumnRenamed("at", "pos"), [*_CONV, "pos"]).select(*_CONV, F.col("following").alias("pos"))
        opened = staged(opened.unionByName(reached), "chat-openings")
        further = ahead.select(*_CONV, F.col("at").alias("following"), F.col("following").alias("beyond"))
        ahead = staged(ahead.join(further, [*_CONV, "following"]).select(*_CONV, "at", F.col("beyond").alias("following")), "chat-ahead")
        if ahead.isEmpty():
            return opened


def _own_turns(turns: DataFrame, budget: int, history: int) -> tuple[DataFrame, DataFrame]:
    """Every turn with its position, prefix sum and window, which is named by its first position; and the conversations' heads."""
    starts = _starts(turns)
    heads = _heads(turns, starts, budget)
    taken = heads.select(*_CONV, F.size("heads").cast("long").alias("n_heads"), "head_cost")
    before = Window.partitionBy(*_CONV, "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    ranged = turns.select(*_CONV, "part", "nth", "cost").withColumn("own", F.coalesce(F.sum("cost").over(before), F.lit(0))).join(starts, [*_CONV, "part"])
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("head_cost", F.lit(0)))
    slim = ranged.join(taken, _CONV, "left").select(
        *_CONV, "part", "nth", (F.col("pos0") + F.col("nth") - F.col("base")).alias("pos"), (F.col("sum0") + F.col("own")).alias("sum"), "cost", room.alias("room"), F.coalesce("n_heads", F.lit(0).cast("long")).alias("n_heads")
    )
    slim = staged(slim, "chat-positions")
    opened = _openings(slim, budget).withColumn("window", F.col("pos"))
    marked = staged(slim.join(opened, [*_CONV, "pos"], "left"), "chat-marked")
    lasts = marked.groupBy(*_CONV, "part").agg(F.max("window").alias("last"))
    carried = lasts.select(*_CONV, "part", F.max("last").over(Window.partitionBy(*_CONV).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = F.max("window").over(Window.partitionBy(*_CONV, "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    windows = marked.withColumn("here", here).join(staged(carried, "chat-carried"), [*_CONV, "part"]).select(*_CONV, "part", "nth", "pos", "n_heads", F.coalesce("here", "carried").alias("window"), "sum")
    placed = turns.join(windows, [*_CONV, "part", "nth"]).select(*_CONV, "pos", "n_heads", "window", "sum", "role", "text", "cost")
    return staged(placed, "chat-placed"), heads


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, cost=default_cost) -> DataFrame:
    """One row for each window: conv_id, window, text, n_turns, n_context, loss (array of start, end in code points), tokens.

    window is the position of its first turn in the conversation. The first n_context turns are repeats (the
    conversation's leading system turns, then up to ``history`` tokens of the turns before the span) and carry no loss.
    tokens counts a window's own span and its context.
    """
    own, heads = _own_turns(_ranged(conversations, cost), budget, history)
    cell = lambda s: F.floor(s / (history + 1))
    opened = own.where("pos = window and window > 0").select(*_CONV, "window", F.col("sum").alias("opens"))
    at = opened.withColumn("cell", F.explode(F.array(cell(F.col("opens")), cell(F.col("opens")) - 1)))
    turn = [F.col(c) for c in ("pos", "role", "text", "cost")]
    past = own.withColumn("cell", cell(F.col("sum"))).withColumnRenamed("window", "in_window").join(at.hint("merge"), [*_CONV, "cell"])
    past = past.where((F.col("pos") < F.col("window")) & (F.col("pos") >= F.col("n_heads")) & (F.col("opens") - F.col("sum") <= history))
    repeated = opened.join(heads.hint("merge"), _CONV).withColumn("h", F.explode("heads")).where("h.pos < window").select(*_CONV, "window", "h.pos", "h.role", "h.text", "h.cost", F.lit(True).alias("context"))
    rows = own.select(*_CONV, "window", *turn, F.lit(False).alias("context")).unionByName(past.select(*_CONV, "window", *turn, F.lit(True).alias("context"))).unionByName(repeated)
    windows = rows.groupBy(*_CONV, "window").agg(F.array_sort(F.collect_list(F.struct("pos", "context", "role", "text", "cost"))).alias("parts"))
    windows = windows.withColumn("n_context", F.size(F.filter("parts", lambda t: t["context"]))).withColumn("pieces", F.transform("parts", rendered))
    lead = F.aggregate(
        F.transform("pieces", lambda p: F.char_length(p).cast("long")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("ends")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array(s["at"] + n)).alias("ends")),
        lambda s: s["ends"],
    )
    placed = windows.withColumn("ends", lead)

    def mask(turn: Column, i: Column) -> Column:
        end = F.get("ends", i) - len("<|end|>")
        wanted = (i >= F.col("n_context")) & (turn["role"] == "assistant")
        return F.when(wanted, F.struct((end - F.char_length(escape(turn["text"]))).alias("start"), end.alias("end")))

    loss = F.filter(F.transform("parts", mask), lambda x: x.isNotNull())
    tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda s, t: s + t["cost"])
    conv_id = F.when(~F.col("nil"), F.col("id")).cast(conversations.schema["conv_id"].dataType).alias("conv_id")
    return placed.select(conv_id, "window", F.array_join("pieces", "").alias("text"), F.size("parts").alias("n_turns"), "n_context", loss.alias("loss"), tokens.alias("tokens"))


def _parsed(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns of its own span, loss_text, chars, from nothing but the formatted windows."""
    marked = F.slice(F.split("text", r"<\|end\|>"), F.col("n_context") + 1, F.col("n_turns") - F.col("n_context"))
    turn = F.transform(
        marked,
        lambda t: F.struct(
            unescape(F.substr(F.substring_index(t, "|>", 1), F.lit(len("<|") + 1))).alias("role"),
            unescape(F.substr(t, F.position(F.lit("|>"), t) + len("|>"))).alias("text"),
        ),
    )
    under = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return windows.select("conv_id", "window", turn.alias("turns"), under.alias("loss_text"), F.char_length("text").cast("long").alias("chars"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, in order), loss_text, formatted_chars of each conversation, whole."""
    whole = _parsed(windows).select("conv_id", F.struct("window", "turns", "loss_text", "chars").alias("w")).groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id",
        F.flatten("w.turns").alias("turns"),
        F.array_join("w.loss_text", "").alias("loss_text"),
        F.aggregate("w.chars", F.lit(0).cast("long"), lambda s, n: s + n).alias("formatted_chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest is of one string, so a conversation's texts meet here, once, and nothing else of it."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parsed = _parsed(windows).select("conv_id", "window", F.size("turns").cast("long").alias("n"), lines.alias("lines"), "loss_text", F.char_length("loss_text").cast("long").alias("loss"), "chars")
    digest = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda w: w[c]), ""), 256)
    return parsed.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), digest("lines").alias("turns_sha256"), F.sum("loss").alias("loss_chars"), digest("loss_text").alias("loss_sha256"), F.sum("chars").alias("formatted_chars")
    )
