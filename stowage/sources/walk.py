"""Walks over listed trees and links, as loops of joins that double their reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import reachable, stored

HOPS = 40
#: Rows of neighbouring paths that are followed together, which bounds a task's memory.
NEIGHBOURS = 1 << 17


def resolved_links(links: DataFrame, hops: int = HOPS) -> DataFrame:
    """Link, final: where each chain of symbolic links ends; NULL for cycles and chains of over ``hops`` links.

    Pointers are doubled, so the chains of 40 take six joins. links: link, target, one row a link.
    """
    ends = links.select("link", F.col("target").alias("final"), F.lit(1).alias("steps"))
    rounds = max(1, (hops - 1).bit_length())
    for _ in range(rounds):
        ahead = ends.select(F.col("link").alias("final"), F.col("final").alias("further"), F.col("steps").alias("more"))
        ends = ends.join(ahead, "final", "left").select("link", F.coalesce("further", "final").alias("final"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    unended = links.select(F.col("link").alias("final")).withColumn("on", F.lit(True))
    return ends.join(unended, "final", "left").select("link", F.when(F.col("on").isNull() & (F.col("steps") <= hops), F.col("final")).alias("final"))


def crawled(children: DataFrame, roots: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] | None = None, most_levels: int | None = None) -> DataFrame:
    """Path, level of all that is reached from the roots, each once, at its least level.

    children: parent, path; roots: path. Where no path has two parents, reach is doubled (``descended``): a tree of
    10,000 levels takes 14 rounds. Otherwise the walk goes level by level, what was seen before being cut off, so cycles
    end. Every round is written to the shared folder (checkpoint: another way to cut its lineage). A tree deeper than
    most_levels, where given, is an error.
    """
    checkpoint = checkpoint or (lambda df: stored(df, "crawl"))
    edges = checkpoint(children.join(roots.select("path"), "path", "left_anti").where("parent <> path").select("parent", "path").distinct())
    if edges.groupBy("path").agg(F.count("*").alias("parents")).where("parents > 1").isEmpty():
        found = descended(edges, roots, checkpoint)
        deepest = found.agg(F.max("level")).first()[0] or 0
    else:
        found, deepest = _by_levels(edges, roots, checkpoint, most_levels)
    if most_levels is not None and deepest > most_levels:
        raise RuntimeError(f"the tree is deeper than {most_levels} levels")
    return found


def descended(edges: DataFrame, roots: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, level below the roots. edges: parent, path, one row a path, none of a root.

    Paths that are strings are sorted first, which brings most next to their ancestors, and each is followed upwards among its neighbours to
    a root or to the first ancestor that lies elsewhere. Reach is then doubled among those ancestors only, and the others
    are looked up once. Where nothing lies near its parent, that is doubling over all paths.
    """
    reachable(edges.sparkSession)
    kind = edges.schema["path"].dataType.simpleString()
    rows = edges.select("path", F.col("parent").alias("at")).unionByName(roots.select("path", F.lit(None).cast(kind).alias("at")).distinct())
    if kind == "string":
        near = rows.repartitionByRange("path").sortWithinPartitions("path").mapInPandas(_followed, "path string, at string, level long")
    else:
        near = rows.withColumn("level", F.col("at").isNotNull().cast("long"))
    near = checkpoint(near)
    far = near.where("at is not null")
    ends = near.join(far.select(F.col("at").alias("path")).distinct(), "path", "left_semi")
    ends = _doubled(checkpoint(ends.select("path", "at", "level", F.col("at").isNull().alias("done"))), checkpoint)
    above = ends.select(F.col("path").alias("at"), F.col("level").alias("more"))
    beyond = far.join(above, "at").select("path", (F.col("level") + F.col("more")).alias("level"))
    return near.where("at is null").select("path", "level").unionByName(beyond).select("path", F.col("level").cast("int").alias("level"))


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, at (null: a root) to path, at, level: at is the first ancestor elsewhere, level steps up, or null where a root was reached."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= NEIGHBOURS:
            yield _climbed(pd.concat(held, ignore_index=True))
            held, rows = [], 0
    if rows:
        yield _climbed(pd.concat(held, ignore_index=True))


def _climbed(rows: pd.DataFrame) -> pd.DataFrame:
    here, root = np.arange(len(rows)), rows["at"].isna().to_numpy()
    to = np.where(root, -1, pd.Index(rows["path"]).get_indexer(rows["at"]))
    leaves = to < 0
    up, level = np.where(leaves, here, to), (~leaves).astype(np.int64)
    for _ in range(len(rows).bit_length()):
        level, up = level + level[up], up[up]
    ended = leaves[up]  # what has not ended goes round, as each has one parent, and is never reached
    top = up[ended]
    return pd.DataFrame({"path": rows["path"].to_numpy()[ended], "at": rows["at"].to_numpy()[top], "level": level[ended] + ~root[top]})


def _doubled(state: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, level of the paths of a state (path, at, level, done) that come to one that is done.

    A path holds an ancestor and takes that one's ancestor next; it is done when the ancestor is. After k rounds all paths
    of fewer than 2**k steps are done, so a round that finishes none leaves only cycles and what hangs off them or off no
    root. What is done leaves the loop, in files of its own, and is only looked up.
    """
    done = [state.where("done")]
    while True:
        left = state.where("not done")
        if left.isEmpty() or len(done) > 1 and done[-1].isEmpty():
            return reduce(DataFrame.unionByName, [d.select("path", "level") for d in done])
        known = reduce(DataFrame.unionByName, done, left)
        ahead = known.select(F.col("path").alias("at"), F.col("at").alias("further"), F.col("level").alias("more"), F.col("done").alias("ends"))
        state = checkpoint(left.join(ahead, "at").select("path", F.col("further").alias("at"), (F.col("level") + F.col("more")).alias("level"), F.col("ends").alias("done")))
        done.append(state.where("done"))


def _by_levels(edges: DataFrame, roots: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], most_levels: int | None) -> tuple[DataFrame, int]:
    levels = [checkpoint(roots.select("path", F.lit(0).alias("level")).dropDuplicates(["path"]))]
    while True:
        frontier = levels[-1]
        found = edges.join(frontier.select(F.col("path").alias("parent")), "parent").select("path", F.lit(len(levels)).alias("level")).dropDuplicates(["path"])
        seen = reduce(DataFrame.unionByName, levels)
        frontier = checkpoint(found.join(seen.select("path"), "path", "left_anti"))
        if frontier.isEmpty():
            return seen, len(levels) - 1
        if most_levels is not None and len(levels) > most_levels:
            return seen, len(levels)
        levels.append(frontier)
