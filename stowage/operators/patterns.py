"""F5-F7 for thousands of patterns: one automaton for all of them, built as it is walked, in place of one test each.

Patterns share a trie of their tokens. A state is the set of trie nodes that the text read so far can stand at; its
moves are worked out once and remembered, so a text takes a step for each character, however many patterns there are.

Lists that are tables themselves, of any size, are joined with the texts (``marked``): a glob is found by the literal
characters that it begins and ends with, a prefix by itself, for each pair of lengths that the list has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.session import reachable, stored

#: Patterns from here on are walked together; at most so many are taken from a table.
MANY, MOST = 64, 1_000_000
#: Remembered moves at most, then they are worked out anew.
MOVES = 500_000


def tokens(pattern: str) -> list | None:
    """A shell pattern's tokens: a character, any, run or a class; None where it is malformed."""
    from stowage.operators.predicates import _class

    out: list = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch in "*?":
            out.append(("run",) if ch == "*" else ("any",))
        elif ch == "[":
            found = _class(pattern, i)
            if found is None:
                return None
            out.append(("class", found[0]))
            i = found[1]
        else:
            if ch == "\\":
                if i == len(pattern):
                    return None
                ch = pattern[i]
                i += 1
            out.append(ch)
    return out


class Automaton:
    """globs match whole texts; prefixes match texts that begin with them."""

    def __init__(self, globs: Iterable[str] = (), prefixes: Iterable[str] = ()):
        self.edges: list[dict] = [{}]  # a node's moves by token
        self.final: set[int] = set()
        self.open: set[int] = set()  # nodes at which a prefix ends
        for pattern in globs:
            if (parts := tokens(pattern)) is not None:
                self.final.add(self._add(parts))
        for prefix in prefixes:
            self.open.add(self._add(list(prefix)))
        self.loops = [False] * len(self.edges)
        for moves in self.edges:
            if ("run",) in moves:
                self.loops[moves[("run",)]] = True
        self.classes = {t: re.compile(t[1], re.S) for moves in self.edges for t in moves if isinstance(t, tuple) and t[0] == "class"}
        self.others = [[(t, to) for t, to in moves.items() if isinstance(t, tuple) and t[0] != "run"] for moves in self.edges]
        self.start = self._closed({0})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}

    def _add(self, parts: list) -> int:
        node = 0
        for token in parts:
            if token not in self.edges[node]:
                self.edges[node][token] = len(self.edges)
                self.edges.append({})
            node = self.edges[node][token]
        return node

    def _closed(self, nodes: set[int]) -> frozenset:
        """With the runs that can be entered for nothing."""
        todo, seen = list(nodes), set(nodes)
        while todo:
            to = self.edges[todo.pop()].get(("run",))
            if to is not None and to not in seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)

    def _move(self, state: frozenset, ch: str) -> frozenset:
        to = set()
        for node in state:
            if (n := self.edges[node].get(ch)) is not None:
                to.add(n)
            if self.loops[node] and ch != "/":
                to.add(node)
            for token, n in self.others[node]:
                if ch != "/" if token[0] == "any" else self.classes[token].fullmatch(ch):
                    to.add(n)
        return self._closed(to)

    def matches(self, text: str) -> bool:
        state = self.start
        if state & self.open:
            return True
        for ch in text:
            key = (state, ch)
            state = self.moves.get(key)
            if state is None:
                if len(self.moves) >= MOVES:
                    self.moves.clear()
                state = self.moves[key] = self._move(*key)
            if not state:
                return False
            if self.open and state & self.open:
                return True
        return bool(state & self.final)


def matches_any(column: str, globs: list[str] = (), prefixes: list[str] = ()) -> Column:
    """Whether the column fits one of the globs or begins with one of the prefixes; null doesn't. One vectorised pass."""
    globs, prefixes, made = list(globs), list(prefixes), []

    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Automaton(globs, prefixes))
        known = {t: made[0].matches(t) for t in texts.dropna().unique()}
        return texts.map(known).fillna(False).astype(bool)

    return test(F.col(column))


def pattern_list(rows: DataFrame, column: str = "pattern") -> list[str]:
    """Patterns from a table; more than MOST are an error, as all tasks hold them."""
    found = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"over {MOST} patterns")
    return found


def _anchors(pattern: Column) -> Column:
    """A glob's literal start and end, and its regular expression; nulls where it is malformed."""
    from stowage.operators.predicates import glob_to_regex

    @F.pandas_udf("struct<head:string,tail:string,regex:string>")
    def run(patterns: pd.Series) -> pd.DataFrame:
        out = []
        for one in patterns:
            parts = tokens(one)
            if parts is None:
                out.append((None, None, None))
                continue
            fixed = [isinstance(t, str) for t in parts]
            head = fixed.index(False) if False in fixed else len(parts)
            tail = fixed[::-1].index(False) if False in fixed else 0
            out.append(("".join(parts[:head]), "".join(parts[len(parts) - tail :]), rf"\A{glob_to_regex(one)[1:-1]}\z"))
        return pd.DataFrame(out, columns=["head", "tail", "regex"])

    return run(pattern)


def marked(rows: DataFrame, column: str, flag: str, globs: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """The rows with a flag: whether the column fits one of the globs or begins with one of the prefixes; null doesn't.

    globs, prefixes: pattern, any number of rows. Globs that neither begin nor end with a literal character can't be
    joined; they are walked together, and over MOST of them are an error.
    """
    reachable(rows.sparkSession)
    texts = rows.select(F.col(column).alias("text")).where("text is not null").distinct()
    found = []
    if globs is not None:
        listed = globs.select("pattern").where("pattern is not null").distinct()
        split = lambda some: some.select("pattern", _anchors(F.col("pattern")).alias("a")).select("pattern", "a.*").where("regex is not null")
        keys = stored(split(listed).where("head <> '' or tail <> ''").select("head", "tail", "regex", F.length("head").alias("n_head"), F.length("tail").alias("n_tail")), "globs")
        shapes = F.broadcast(keys.select("n_head", "n_tail").distinct())
        cut = texts.join(shapes, F.length("text") >= F.col("n_head") + F.col("n_tail")).select("text", F.expr("left(text, n_head)").alias("head"), F.expr("right(text, n_tail)").alias("tail"), "n_head", "n_tail")
        same = (F.col("t.head") == F.col("k.head")) & (F.col("t.tail") == F.col("k.tail")) & (F.col("t.n_head") == F.col("k.n_head")) & (F.col("t.n_tail") == F.col("k.n_tail"))
        found.append(cut.alias("t").join(keys.alias("k"), same & F.rlike(F.col("text"), F.col("regex")), "left_semi").select("text"))
        if loose := pattern_list(split(listed.where("left(pattern, 1) in ('*', '?', '[') or pattern = ''")).where("head = '' and tail = ''")):
            found.append(texts.where(matches_any("text", loose)))
    if prefixes is not None:
        starts = prefixes.select(F.col("pattern").alias("head"), F.length("pattern").alias("n_head")).where("head is not null").distinct()
        lengths = F.broadcast(starts.select("n_head").distinct())
        cut = texts.join(lengths, F.length("text") >= F.col("n_head")).select("text", F.expr("left(text, n_head)").alias("head"), "n_head")
        found.append(cut.join(starts, ["head", "n_head"], "left_semi").select("text"))
    hits = reduce(DataFrame.unionByName, found).distinct().select(F.col("text").alias(column), F.lit(True).alias("hit")) if found else None
    return rows.withColumn(flag, F.lit(False)) if hits is None else rows.join(hits, column, "left").withColumn(flag, F.coalesce("hit", F.lit(False))).drop("hit")
