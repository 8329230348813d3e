import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stowage.operators import hardlinks as h
from stowage.operators import reconcile as r

SCHEMA = "container string, relative_path string, entity_type string, size long, md5 string, last_modified timestamp_ntz"
T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def side(spark, rows):
    return spark.createDataFrame([("c", p, k, 1, m, None if t is None else T(t)) for p, k, m, t in rows], SCHEMA)


def plan(spark, src, dst, **o):
    return {x.relative_path: (x.action, x.reason) for x in r.sync_plan(side(spark, src), side(spark, dst), **o).collect()}


def test_decision_table(spark):
    src = [("new", "File", "a", 1), ("same", "File", "a", 9), ("differs", "File", "a", 1), ("nohash_new", "File", None, 9), ("nohash_old", "File", None, 1), ("kind", "Hardlink", "a", 1), ("folder", "Folder", None, 5), ("tie", "Folder", None, 5)]
    dst = [("same", "File", "a", 1), ("differs", "File", None, 9), ("nohash_new", "File", "b", 1), ("nohash_old", "File", "b", 9), ("kind", "File", "a", 1), ("folder", "Folder", None, 1), ("tie", "Folder", None, 5), ("extra", "File", "a", 1)]
    got = {k: (a, next(n for n, t in r.REASONS.items() if t == w)) for k, (a, w) in plan(spark, src, dst).items()}
    assert got == {
        "new": ("transfer", "only_source"), "same": ("skip", "skip_hash"), "differs": ("transfer", "hash"), "nohash_new": ("transfer", "time_no_hash"), "nohash_old": ("skip", "skip_time_no_hash"),
        "kind": ("replace", "entity"), "folder": ("transfer", "time"), "tie": ("skip", "skip_time"), "extra": ("delete", "only_destination"),
    }
    assert plan(spark, src, dst, delete="false")["extra"][0] == "keep" and plan(spark, src, dst, delete="prompt")["extra"][0] == "prompt"
    assert {a for a, _ in plan(spark, src, src, mirror=True).values()} == {"transfer"}


def test_repeated_keys_and_case(spark):
    src = [("A/x", "File", "1", 1), ("a/X", "File", "2", 5)]
    got = plan(spark, src, [("a/x", "File", "2", 1)], ignore_case=True)
    assert got == {"a/X": ("skip", r.REASONS["skip_hash"])}
    assert len(plan(spark, src, [("a/x", "File", "2", 1)])) == 3


_SIDE = st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.sampled_from(["File", "Folder", "Symlink"]), st.sampled_from(["m", "n", None]), st.integers(0, 3)), max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(_SIDE, _SIDE)
def test_a_plan_is_a_partition_and_applying_it_ends_it(spark, a, b):
    src, dst = [(p, *x) for p, x in a.items()], [(p, *x) for p, x in b.items()]
    got = plan(spark, src, dst)
    assert set(got) == set(a) | set(b)
    after = {p: x for p, x in b.items() if got[p][0] != "delete"} | {p: a[p] for p in got if got[p][0] in ("transfer", "replace")}
    again = plan(spark, src, [(p, *x) for p, x in after.items()])
    assert all(action == "skip" for action, _ in again.values())


@pytest.mark.parametrize("start,stop,hit", [(512, 1023, True), (2048, 3071, True), (3071, 4606, True), (0, 511, False), (1536, 2559, False), (15360, 15871, False)])
def test_range_overlap(spark, start, stop, hit):
    pages = spark.createDataFrame([("f", 512, 1023), ("f", 2560, 4095), ("f", 7168, 8191)], "k string, start long, stop long")
    ranges = spark.createDataFrame([("f", start, stop)], "k string, start long, stop long")
    assert (r.overlapping(pages, ranges, 1000, ["k"]).count() == 1) == hit


def test_no_page_list_means_full(spark):
    pages = spark.createDataFrame([], "k string, start long, stop long")
    assert r.overlapping(pages, spark.createDataFrame([("g", 0, 5)], "k string, start long, stop long"), 1000, ["k"]).count() == 1


LINK = "relative_path string, entity_type string, inode string, size long, md5 string, last_modified timestamp_ntz"


def links(spark, groups, files=(), size=1, time=0):
    rows = [(p, "Hardlink", i, size, None, T(time)) for i, members in groups.items() for p in members] + [(p, "File", None, size, None, T(time)) for p in files]
    return spark.createDataFrame(rows, LINK)


def link_actions(spark, src, dst, **o):
    return {x.relative_path: x.action for x in h.link_plan(src, dst, **o).collect()}


def test_anchor_is_the_least_path(spark):
    assert [x.anchor for x in h.anchors(links(spark, {"1": ["b", "a", "B"]})).collect()] == ["B"]


@pytest.mark.parametrize(
    "name,src,src_files,dst,dst_files,want",
    [
        ("unchanged", {"1": "ab"}, "", {"9": "ab"}, "", {"a": "skip", "b": "skip"}),
        ("merge", {"1": "abcd"}, "", {"8": "ab", "9": "cd"}, "", {"a": "transfer", "b": "skip", "c": "replace", "d": "replace"}),
        ("split", {"1": "ab", "2": "cd"}, "", {"9": "abcd"}, "", {"a": "transfer", "b": "skip", "c": "replace", "d": "replace"}),
        ("to files", {}, "ab", {"9": "ab"}, "", {"a": "skip", "b": "replace"}),
        ("one leaves", {"1": "ab"}, "c", {"9": "abc"}, "", {"a": "skip", "b": "skip", "c": "replace"}),
        ("stale link", {"1": "ab"}, "", {"9": "abz"}, "", {"a": "skip", "b": "skip", "z": "delete"}),
        ("retarget", {"1": "ab", "2": "cx"}, "", {"8": "abx", "9": "c"}, "", {"a": "transfer", "b": "skip", "c": "transfer", "x": "replace"}),
        ("file joins", {"1": "abc"}, "", {"9": "bc"}, "a", {"b": "replace", "c": "replace"}),
        ("anchor renamed", {"1": "bc"}, "", {"9": "abc"}, "", {"a": "delete", "b": "skip", "c": "skip"}),
    ],
)
def test_link_scenarios(spark, name, src, src_files, dst, dst_files, want):
    assert link_actions(spark, links(spark, src, src_files), links(spark, dst, dst_files)) == want


def test_anchor_content(spark):
    same = {"1": "ab"}
    assert link_actions(spark, links(spark, same, size=2), links(spark, same)) == {"a": "transfer", "b": "skip"}
    assert link_actions(spark, links(spark, same, time=5), links(spark, same)) == {"a": "transfer", "b": "skip"}
    assert link_actions(spark, links(spark, same), links(spark, same), mirror=True) == {"a": "transfer", "b": "skip"}
