"""The prefix trie of conversations, rolled up by pointer jumping, with DataFrame functions but for one digest.

A node is a sequence of first turns. Its key is the sum, in four lanes of 32 bits, of a SHA-256 of every turn and its
place, so the key of a prefix follows from sums over ranges of turns and a node's parent is the key without the last
turn: no conversation is gathered, not even one with a third of all turns. Equal keys are one node.

Leaves and savings reach all ancestors in rounds: a node holds the sums of its descendants within 2**k levels and a
pointer to its ancestor 2**k levels up. A round adds what points at a node to its sums and replaces a pointer by the
pointer of its target, so a trie of 1,000 levels takes ten rounds. Each round is written to the shared folder.

What is put together first (``rebuilt``): the first h turns of the conversation that heads a block of twenty ids, then
a conversation's own turns after its first h, h being its id's checksum modulo 4.

Defined results: null roles and texts are empty; turns are ordered by turn, nulls first, and those with one turn number
by the SHA-256 of role and text, so ties and repeated rows have one order; rows with a null conv_id are one
conversation with h = 0, which counts as a member but has no id to name or to list; an empty table gives the root
without members; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.common import staged
from stowage.session import reachable

#: Conversations of a block share the turns of its first; most turns that they share.
SHARING, MOST_SHARED = 20, 3
#: Ids that one fragment of a list of members holds at most.
FRAGMENT = 4096
WORD = r"[^\x20\x09-\x0D]+"
_CONV, _KEY = ["nil", "id"], ["depth", "ka", "kb"]
_LANES = ["x1", "x2", "x3", "x4"]


def _numbered(conversations: DataFrame) -> DataFrame:
    """The turns in order: nil, id, mark (a digest of role and text), words, part and nth: a range and the place in it."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select(F.col("conv_id").isNull().alias("nil"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"), "turn", mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = [F.col("nil").asc(), F.col("id").asc(), F.col("turn").asc_nulls_first(), F.col("mark").asc()]
    seq = turns.repartitionByRange(tasks, *first).sortWithinPartitions(*first).withColumn("seq", F.monotonically_increasing_id())
    return staged(seq.select(*_CONV, "mark", "words", F.shiftright("seq", 33).cast("int").alias("part"), F.col("seq").bitwiseAND((1 << 33) - 1).alias("nth")), "conversation-turns")


def shared_turns(id: Column) -> Column:
    """How many turns a conversation takes from the head of its block."""
    return F.crc32(id.cast("string")) % (MOST_SHARED + 1)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, plan). turns: nil, id, part, depth, mark, words, in rebuilt conversations; plan: nil, id, length of each of them."""
    turns = _numbered(conversations)
    ranges = turns.groupBy(*_CONV, "part").agg(F.min("nth").alias("base"), F.count("*").alias("n"))
    before = Window.partitionBy(*_CONV).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = staged(ranges.withColumn("pos0", F.coalesce(F.sum("n").over(before), F.lit(0))), "conversation-ranges")
    whole = ranges.groupBy(*_CONV).agg(F.sum("n").alias("n"))
    heads = whole.where("not nil").select(F.col("id").alias("head"), F.col("n").alias("head_n"))
    plan = whole.withColumn("h", F.when(F.col("nil"), 0).otherwise(shared_turns(F.col("id")))).withColumn("head", F.when(~F.col("nil"), F.col("id") - F.col("id") % SHARING))
    plan = plan.join(heads, "head", "left").withColumn("taken", F.least(F.col("h"), F.coalesce("head_n", F.lit(0))))
    plan = plan.select(*_CONV, "h", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    plan = staged(plan, "conversation-plan")
    placed = staged(turns.join(ranges.select(*_CONV, "part", "base", "pos0"), [*_CONV, "part"]).withColumn("pos", F.expr("pos0 + nth - base + 1")).select(*_CONV, "part", "pos", "mark", "words"), "conversation-places")
    own = placed.join(plan, _CONV).where("pos > h").select(*_CONV, "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "mark", "words")
    first = placed.where(~F.col("nil") & (F.col("pos") <= MOST_SHARED)).select(F.col("id").alias("head"), "pos", "mark", "words")
    taken = plan.where("taken > 0").join(first, "head").where("pos <= taken").select(*_CONV, F.lit(-1).alias("part"), F.col("pos").alias("depth"), "mark", "words")
    return own.unionByName(taken), plan.select(*_CONV, "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """nil, id, depth, key (ka, kb), parent's key (pa, pb) and words of every prefix but the empty one."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("mark")), 256)
    lane = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    salted = staged(turns.select(*_CONV, "part", "depth", "words", *[lane(k).alias(x) for k, x in enumerate(_LANES)]), "conversation-lanes")
    sums = salted.groupBy(*_CONV, "part").agg(*[F.sum(x).alias(x) for x in _LANES])
    before = Window.partitionBy(*_CONV).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = staged(sums.select(*_CONV, "part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"c{x}") for x in _LANES]), "conversation-carries")
    here = Window.partitionBy(*_CONV, "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = staged(salted.select(*_CONV, "part", "depth", "words", *_LANES, *[F.sum(x).over(here).alias(f"s{x}") for x in _LANES]), "conversation-sums")
    rows = running.join(carried, [*_CONV, "part"])
    now = [F.col(f"s{x}") + F.col(f"c{x}") for x in _LANES]
    then = [s - F.col(x) for s, x in zip(now, _LANES, strict=True)]
    packed = lambda a, b: F.shiftleft(a % (1 << 31), 32).bitwiseOR(b % (1 << 32))
    return rows.select(*_CONV, "depth", "words", packed(*now[:2]).alias("ka"), packed(*now[2:]).alias("kb"), packed(*then[:2]).alias("pa"), packed(*then[2:]).alias("pb"))


def roll_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes: depth, ka, kb, parent's key (pa, pb) and numbers; those named in ``sums`` become sums over the subtree, the top included."""
    state = nodes.select(*_KEY, *[F.when(F.col("depth") > 0, F.col(p)).alias(q) for p, q in (("pa", "qa"), ("pb", "qb"))], *sums)
    deepest, step = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        up = (F.col("depth") - step).alias("depth")
        arrived = state.where("qa is not null").groupBy(up, F.col("qa").alias("ka"), F.col("qb").alias("kb")).agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        targets = state.where("qa is not null").select((F.col("depth") + step).alias("at"), F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.col("qa").alias("na"), F.col("qb").alias("nb"))
        added = state.join(arrived, _KEY, "left").select(*_KEY, "qa", "qb", *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums])
        jumped = added.join(targets.withColumnRenamed("at", "depth"), ["depth", "qa", "qb"], "left")
        state = staged(jumped.select(*_KEY, F.col("na").alias("qa"), F.col("nb").alias("qb"), *sums), "conversation-round")
        step *= 2
    return state.select(*_KEY, *sums)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key and block: one running SHA-256 for each key, so a list of any length needs no memory."""
    now, sha = None, None
    for batch in batches:
        done = []
        for depth, ka, kb, ids in batch[["depth", "ka", "kb", "ids"]].itertuples(index=False):
            if (depth, ka, kb) != now:
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = (depth, ka, kb), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pd.DataFrame(done, columns=[*_KEY, "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*_KEY, "ends_sha256"])


def _listed(ends: DataFrame) -> DataFrame:
    """depth, ka, kb, ends_sha256 of the nodes at which conversations end. ends: key and id."""
    reachable(ends.sparkSession)
    fragments = ends.groupBy(*_KEY, F.floor(F.col("id") / FRAGMENT).alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    fragments = fragments.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
    dealt = fragments.repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEY).sortWithinPartitions(*_KEY, "block")
    return dealt.mapInPandas(_digests, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each node of the trie of the conversations that ``rebuilt`` gives (or any in its form)."""
    prefixes = staged(_prefixes(turns), "conversation-prefixes")
    named = F.when(~F.col("nil"), F.col("id"))
    nothing = F.lit(0).cast("long")
    nodes = prefixes.groupBy(*_KEY).agg(F.min(named).alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    root = plan.agg(F.min(named).alias("conv_id"), F.count("*").alias("n_convs")).select(nothing.alias("depth"), nothing.alias("ka"), nothing.alias("kb"), "conv_id", "n_convs", nothing.alias("words"), nothing.alias("pa"), nothing.alias("pb"))
    nodes = staged(nodes.unionByName(root), "conversation-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", nothing))
    nodes = staged(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "conversation-children")
    sums = roll_up(nodes, ["n_leaves", "saved_tokens"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    last = prefixes.where("not nil").join(plan, _CONV).where("depth = length").select(*_KEY, "id")
    ended = staged(_listed(last.unionByName(plan.where("not nil and length = 0").select(nothing.alias("depth"), nothing.alias("ka"), nothing.alias("kb"), "id"))), "conversation-ends")
    rows = nodes.drop("n_leaves", "saved_tokens").join(sums, _KEY).join(ended, _KEY, "left").join(parents, ["depth", "pa", "pb"], "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return prefix_trie(*rebuilt(conversations))
