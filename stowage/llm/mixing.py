"""Mixing sources to target weights by Pfair scheduling.

A source's rows are put in a seeded order and cut into blocks. With weight w, its block j may not be placed before slot
floor(j / w) and must be placed before slot ceil((j + 1) / w); earliest deadline first over the released blocks meets
every deadline, so at any slot each source has had its share to within less than one block.

Weights are whole numbers over one period, so the schedule of a period repeats: a small table (period slot of each of a
source's blocks) gives every block's slot by division, and no machine walks through the blocks. Where the targets have a
common denominator of up to MOST_PERIOD the period has them exactly, so the deviation is from the targets themselves, at
any slot; other targets, as tempered sizes, are rounded to whole slots of PERIOD first, one at least. When a source runs out, the
others go on with their weights in the same proportion: a phase of its own. All rows are kept; each has one position.

Defined results: a null source is a source; a source without a target has the mean target weight; rows of a source are ordered by
(seeded hash of doc_id, doc_id), so equal or null ids may swap places with each other only; an empty table gives no
rows; any number of sources is planned, in time that grows with its square; other columns are ignored or, in ``mixed_documents``, kept.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.common import staged

BLOCK_ROWS = 32
#: Slots of a period where no period up to MOST_PERIOD has the targets exactly.
PERIOD, MOST_PERIOD = 4096, 1 << 16
#: Rows of the plan that are broadcast at most; a longer one, of very many sources, is joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Pieces of a source's seeded order that are ranked apart from each other.
PIECES = 1024
TEMPERATURE = 0.5


def exact_period(targets: dict) -> int | None:
    """The least number of slots in which every target is a whole number of slots; None beyond MOST_PERIOD."""
    exact = {s: Fraction(str(w)) for s, w in targets.items()}
    total = sum(exact.values())
    slots = math.lcm(*((w / total).denominator for w in exact.values())) if total > 0 and min(exact.values()) > 0 else MOST_PERIOD + 1
    return slots if slots <= MOST_PERIOD else None


def whole_weights(targets: dict, period: int | None = None) -> dict:
    """Weights as whole slots of a period, at least one each: largest remainders of the normalised targets.

    Without a period it is the least one that has the targets exactly, else PERIOD slots, and four for each source at least.
    """
    period = (exact_period(targets) or max(PERIOD, 4 * len(targets))) if period is None else max(period, 4 * len(targets))
    exact = {s: Fraction(str(w)) for s, w in targets.items()}
    total = sum(exact.values())
    exact = {s: w / total * period for s, w in exact.items()}
    slots = {s: max(1, math.floor(x)) for s, x in exact.items()}
    spare = period - sum(slots.values())
    by_rest = sorted(exact, key=lambda s: (slots[s] - exact[s], str(s)))
    for s in by_rest[: max(0, spare)]:
        slots[s] += 1
    for s in sorted(slots, key=lambda s: (-slots[s], str(s))):  # what the least ones took comes from the largest
        taken = min(slots[s] - 1, max(0, -spare))
        slots[s], spare = slots[s] - taken, spare + taken
    return slots


def period_schedule(slots: dict, until: dict | None = None) -> list[tuple[object, int]]:
    """(source, its block within the period) for each slot: earliest deadline first among the released blocks.

    until: blocks that each source has; the schedule ends before the first slot that asks for more.
    """
    period, out, ready = sum(slots.values()), [], []
    waiting = [(0, repr(s), s, 0) for s in slots]  # (release, name, source, block)
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, name, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // slots[s]), name, k, s))
        _, name, k, s = heapq.heappop(ready)
        if until is not None and k >= until[s]:
            break
        out.append((s, k))
        if k + 1 < slots[s]:
            heapq.heappush(waiting, ((k + 1) * period // slots[s], name, s, k + 1))
    return out


def phases(blocks: dict, targets: dict, period: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """The plan. Phases: (source, phase, first block, end block, blocks a period, period, first slot). Places: (source, phase, k, slot)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used, base, plan, places = dict.fromkeys(left, 0), 0, [], []
    for phase in range(len(left)):
        if not left:
            break
        slots = whole_weights({s: targets[s] for s in left}, period)
        length = sum(slots.values())
        full = min(left[s] // slots[s] for s in left)
        rest = {s: left[s] - full * slots[s] for s in left}
        order = period_schedule(slots, None if full else rest)  # a phase shorter than a period needs no more of it
        tail = next((t for t, (s, k) in enumerate(order) if k >= rest[s]), len(order))  # the last period ends where a source has no block
        part = Counter(s for s, _ in order[:tail])
        took = {s: full * slots[s] + part[s] for s in left}
        for s in left:
            plan.append((s, phase, used[s], used[s] + took[s], slots[s], length, base))
            used[s] += took[s]
        places += [(s, phase, k, t) for t, (s, k) in enumerate(order)]
        base += full * length + tail
        left = {s: left[s] - took[s] for s in left if left[s] > took[s]}
    return plan, places


def tempered(counts: dict, temperature: float = TEMPERATURE) -> dict:
    return {s: n**temperature for s, n in counts.items()}


def _seeded(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, F.lit(seed))


def mix(docs: DataFrame, targets: dict | None = None, block_rows: int = BLOCK_ROWS, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, rank (in its source), block, slot, place (in its block), and the kept columns, for every row.

    targets: weight of each source; None tempers the sources' sizes. Ranks are counted piece by piece, so a source with
    a third of all rows is spread over PIECES tasks.
    """
    spark = docs.sparkSession
    h = _seeded(F.col("doc_id"), seed)
    rows = docs.select("doc_id", "source", *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]).withColumn("h", h)
    rows = rows.withColumn("piece", F.shiftrightunsigned("h", 64 - (PIECES - 1).bit_length()).cast("int"))
    sizes = staged(docs.select("source", h.alias("h")).groupBy("source", F.shiftrightunsigned("h", 64 - (PIECES - 1).bit_length()).cast("int").alias("piece")).agg(F.count("*").alias("n")), "mix-pieces")
    counts = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a number for each source
    weights = tempered(counts) if targets is None else {s: float(targets.get(s, sum(targets.values()) / max(1, len(targets)))) for s in counts}
    plan, places = phases({s: -(-n // block_rows) for s, n in counts.items()}, weights)
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("source").alias("s"), F.col("piece").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "piece").orderBy("h", "doc_id")
    ranked = (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(small(offsets, PIECES * len(counts)), F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
        .withColumn("rank", F.col("offset") + F.col("nth"))
        .withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    )
    plan, places = plan or [(None, 0, 0, 0, 1, 1, 0)], places or [(None, 0, 0, 0)]
    spans = spark.createDataFrame(plan, "ps string, phase int, first long, stop long, share long, period long, base long")
    table = spark.createDataFrame(places, "ss string, in_phase int, k long, t long")
    slotted = (
        ranked.join(small(spans, len(plan)), F.col("source").eqNullSafe(F.col("ps")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("stop")))
        .withColumn("j", F.col("block") - F.col("first"))
        .join(small(table, len(places)), F.col("source").eqNullSafe(F.col("ss")) & (F.col("phase") == F.col("in_phase")) & (F.col("j") % F.col("share") == F.col("k")))
    )
    slot = F.col("base") + F.floor(F.col("j") / F.col("share")) * F.col("period") + F.col("t")
    return slotted.select("doc_id", "source", "rank", "block", slot.cast("long").alias("slot"), (F.col("rank") - F.col("block") * block_rows).alias("place"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def mixed_documents(docs: DataFrame, targets: dict | None = None, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """The documents, all of them with their columns, in the order of the schedule."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("source").cast("string").alias("source"))
    placed = mix(rows, targets, block_rows, seed, keep=("row",))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")
