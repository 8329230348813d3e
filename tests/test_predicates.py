import random
import re

import pytest
from pyspark.sql import functions as F

from stowage.operators import patterns
from stowage.operators import predicates as p

def fits(pattern, text):
    """An independent matcher, by recursion on the pattern's clauses; None where the pattern is malformed."""
    if not pattern:
        return not text
    head, rest = pattern[0], pattern[1:]
    if head == "*":
        return any(fits(rest, text[k:]) for k in range(len(text) + 1) if "/" not in text[:k])
    if head == "?":
        return bool(text) and text[0] != "/" and fits(rest, text[1:])
    if head == "\\":
        return bool(text) and text[0] == rest[0] and fits(rest[1:], text[1:])
    return bool(text) and text[0] == head and fits(rest, text[1:])


def drawn(seed, n, letters, longest):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)})


def passing(spark, names, condition, column="name"):
    df = spark.createDataFrame([(n,) for n in names], f"{column} string")
    return [r[0] for r in df.where(condition).collect()]


@pytest.mark.parametrize("seed,n", [(1, 12), (2, 40)])
def test_lists_of_globs_pass_what_one_of_them_fits(spark, seed, n):
    names, globs = drawn(seed, 300, "ab/.é", 7), drawn(seed + 10, n, "ab/.é*?", 6)
    hit = [x for x in names if any(fits(g, x) for g in globs)]
    assert 0 < len(hit) < len(names)
    assert passing(spark, names, p.include_pattern(globs)) == hit
    assert passing(spark, names, p.exclude_pattern(globs)) == [x for x in names if x not in hit]


def test_thousands_of_patterns_are_one_automaton(spark):
    names = drawn(3, 1500, "abc/.é", 9)
    globs, prefixes = drawn(4, 3000, "abc/.é?*", 8) + ["[ab]c*", "[^a]?", "[", "\\*x"], [x for x in drawn(5, 400, "abc/", 6) if len(x) > 2]
    slow = [re.compile(r) for g in globs if (r := p.glob_to_regex(g))]
    hit = [x for x in names if any(r.match(x) for r in slow)]
    assert passing(spark, names, p.include_pattern(globs)) == hit and 0 < len(hit) < len(names)
    assert passing(spark, [*names, None], p.exclude_pattern(globs)) == [x for x in [*names, None] if x not in hit]
    assert passing(spark, names, p.exclude_path(prefixes), "relative_path") == passing(spark, names, ~F.col("relative_path").rlike("^(" + "|".join(map(re.escape, prefixes)) + ")"), "relative_path")
    walked = patterns.Automaton(prefixes=["", "x"])
    assert walked.matches("anything") and not patterns.Automaton(globs=[]).matches("")


def test_patterns_from_a_table_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "pattern string")
    assert sorted(patterns.pattern_list(df)) == ["a", "b"]
    monkeypatch.setattr(patterns, "MOST", 1)
    with pytest.raises(ValueError, match="over 1"):
        patterns.pattern_list(df)


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        ("*.txt", ["a.txt", ".txt"], ["a/b.txt", "a.txtx"]),
        ("a?c", ["abc", "a.c"], ["ac", "a/c"]),
        ("[a-c]x", ["ax", "cx"], ["dx", "x"]),
        ("[^a]x", ["bx"], ["ax"]),
        (r"\*a", ["*a"], ["ba"]),
        ("a+b(c)", ["a+b(c)"], ["aab(c)"]),
        ("[]a]", [], ["a"]),
    ],
)
def test_globs(pattern, yes, no):
    r = p.glob_to_regex(pattern)
    if r is None:
        assert not yes
        return
    r = r.replace("(?s:", "(?:")
    assert all(re.match(r, s, re.S) for s in yes) and not any(re.match(r, s, re.S) for s in no)


@pytest.mark.parametrize("bad", ["[", "[a", "a\\", "[a-", "[-x]"])
def test_malformed_globs(spark, bad):
    assert p.glob_to_regex(bad) is None
    assert passing(spark, ["x"], p.exclude_pattern([bad])) == ["x"] and passing(spark, ["x"], p.include_pattern([bad])) == []


def test_no_pattern_passes_everything(spark):
    assert passing(spark, ["x"], p.include_pattern([]) & p.include_regex([], "name") & p.exclude_regex([], "name")) == ["x"]


def test_file_filters_pass_other_kinds(spark):
    df = spark.createDataFrame([("a", "File"), ("a", "Folder"), ("a", "Symlink"), ("a", "Hardlink")], "name string, entity_type string")
    assert [r[1] for r in df.where(p.files_only(p.include_pattern(["b"]))).collect()] == ["Folder", "Symlink"]


def test_regex_stops_at_the_first_broken_pattern(spark):
    assert passing(spark, ["ab", "cd"], p.exclude_regex(["a", "(", "c"], "name")) == ["cd"]
    assert passing(spark, ["ab", "cd"], p.include_regex(["(", "c"], "name")) == ["cd"]
    assert not p.shared_regex("(?=a)") and not p.shared_regex(r"(a)\1") and p.shared_regex("a+?b")


def test_unknown_time_is_an_error(spark):
    df = spark.createDataFrame([(None,)], "last_modified timestamp_ntz")
    with pytest.raises(Exception, match="unknown last-modified"):
        df.where(p.include_after("2024-01-01")).collect()


def test_entity_policy(spark):
    df = spark.createDataFrame([(e, path) for e in ("File", "Folder", "Symlink", "Hardlink", "Other") for path in ("", "a")], "entity_type string, relative_path string")
    kept = lambda **o: {tuple(r) for r in df.where(p.entity_policy(**o)).collect()}
    assert ("Folder", "") not in kept(folders="all_except_root") and ("Folder", "a") in kept(folders="all_except_root")
    assert ("Symlink", "a") in kept(symlinks="preserve") and ("Hardlink", "a") not in kept(hardlinks="skip") and not any(e == "Other" for e, _ in kept())


def test_pushdown_prefix_and_folder_option():
    assert p.Filters(include=["abc*"], recursive=False).pushdown_prefix() == "abc"
    assert p.Filters(include=["abc*"]).pushdown_prefix() == "" and p.Filters(include=["a?c*"], recursive=False).pushdown_prefix() == ""
    assert p.Filters(include=["a"]).folder_option() == "none" and p.Filters(exclude_paths=["a"]).folder_option() == "all"


def test_collisions(spark):
    df = spark.createDataFrame([("A/x",), ("a/X",), ("b",)], "destination string")
    assert [tuple(r) for r in p.collisions(df).collect()] == [("a/x", 2)]
    assert p.collisions(df, ignore_case=False).count() == 0


def test_system_containers(spark):
    df = spark.createDataFrame([("$logs",), ("%24logs",), ("$web",), (None,), ("%zz",)], "container string")
    assert [r[0] for r in df.where(p.is_system_container()).collect()] == ["$logs", "%24logs"]


def test_bits(spark):
    df = spark.createDataFrame([(1,), (32,), (None,)], "attributes int")
    assert [r[0] for r in df.where(p.attributes("R;A", True)).collect()] == [1, 32] and [r[0] for r in df.where(p.attributes("R", False)).collect()] == [32, None]
    assert df.where(F.lit(True) & p.with_status("All", "attributes")).count() == 3
