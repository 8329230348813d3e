import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stowage.client import Client
from stowage.operators import jobs
from stowage.operators.predicates import Filters
from stowage.plans import parts
from stowage.sources import folders, scans, walk
from stowage.streaming import jobs as live


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "a/b").mkdir(parents=True)
    (root / "top.txt").write_text("one")
    (root / "a/x.txt").write_text("three")
    (root / "a/b/y.txt").write_text("")
    os.link(root / "a/x.txt", root / "a/b/hard.txt")
    os.symlink(root / "top.txt", root / "a/soft")
    os.symlink(root, root / "a/b/loop")
    return str(root)


def test_local_scan(spark, tree):
    rows = {r.relative_path: r for r in scans.local_files(spark, tree, with_md5=True).collect()}
    assert {"top.txt", "a/x.txt", "a/b/y.txt"} <= set(rows) and rows["top.txt"]["size"] == 3 and rows["a/x.txt"].md5 == "35d6d33467aae9a2e3dccb4b6b027878"
    assert rows["a/b/y.txt"].md5 == "d41d8cd98f00b204e9800998ecf8427e" and rows["a"].md5 is None
    assert sorted(r.relative_path for r in scans.open_inventory(spark, tree, "local", recursive=False).collect()) == ["a", "top.txt"]
    assert [r.relative_path for r in scans.local_files(spark, tree + "/a/*.txt").collect()] == ["x.txt"]
    assert [(r.relative_path, r.name) for r in scans.local_files(spark, tree + "/top.txt").collect()] == [("", "top.txt")]


def test_live_listing_with_links(spark, tree):
    kinds = {r.relative_path: r.entity_type for r in folders.folder_listing(spark, tree).collect()}
    assert kinds == {"top.txt": "File", "a": "Folder", "a/x.txt": "Hardlink", "a/soft": "Symlink", "a/b": "Folder", "a/b/y.txt": "File", "a/b/hard.txt": "Hardlink", "a/b/loop": "Symlink"}
    followed = {r.relative_path for r in folders.folder_listing(spark, tree, follow_symlinks=True).collect()}
    assert followed == {"top.txt", "a", "a/x.txt", "a/soft", "a/b", "a/b/y.txt", "a/b/hard.txt"}  # the loop leads to what is listed
    assert {r.relative_path for r in folders.folder_listing(spark, tree, recursive=False).collect()} == {"top.txt", "a"}


def test_a_deep_branch_is_dealt_out_and_linked_folders_come_once(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    for k in range(12):
        (root / "only/one/way/down" / f"d{k}").mkdir(parents=True)
        (root / "only/one/way/down" / f"d{k}/f{k}.txt").write_text("x" * k)
    (root / "b").mkdir()
    (out / "deeper").mkdir(parents=True)
    (out / "deeper/g.txt").write_text("g")
    for link, target in (("b/cross", root / "only/one"), ("b/far", out / "deeper"), ("z", out), ("b/also", out), ("b/gone", tmp_path / "nowhere"), ("b/up", tmp_path)):
        os.symlink(target, root / link)
    pieces = folders.FolderReader({"path": str(root), "pieces": "8"}).partitions()
    assert sum(len(p.folders) for p in pieces if p.whole) >= 8
    got = [r.relative_path for r in folders.folder_listing(spark, str(root), follow_symlinks=True, pieces=8).collect()]
    own = ["only", "only/one", "only/one/way", "only/one/way/down", *[f"only/one/way/down/d{k}" for k in range(12)], *[f"only/one/way/down/d{k}/f{k}.txt" for k in range(12)], "b", "b/gone"]
    # The folder above holds the root and all that the other links lead to, so it is listed under its link and they are not.
    assert sorted(got) == sorted([*own, "b/up", "b/up/out", "b/up/out/deeper", "b/up/out/deeper/g.txt"])
    os.remove(root / "b/up")
    got = [r.relative_path for r in folders.folder_listing(spark, str(root), follow_symlinks=True, pieces=8).collect()]
    assert sorted(got) == sorted([*own, "b/also", "b/also/deeper", "b/also/deeper/g.txt"])


def test_filters_reach_the_reader_and_close_folders(spark, tree):
    found = folders.folder_listing(spark, tree, "relative_path like 'a/b%' and size >= 0 and name in ('y.txt', 'hard.txt', 'loop')")
    assert sorted(r.name for r in found.collect()) == ["hard.txt", "loop", "y.txt"]
    both = [folders.folder_listing(spark, tree, f"name = '{n}'") for n in ("x.txt", "y.txt")]  # two filters over one folder don't mix
    assert sorted(r.name for r in both[0].union(both[1]).collect()) == ["x.txt", "y.txt"]
    reader = folders.FilteringReader({"path": tree, "pieces": "1"})
    kept = list(reader.pushFilters([folders.d.StringStartsWith(("relative_path",), "a/b"), folders.d.Not(folders.d.EqualTo(("name",), "x"))]))
    assert len(kept) == 1 and not reader._open(tree + "/c", "c") and reader._open(tree + "/a", "a") and reader._open(tree + "/a/bc", "a/bc")
    assert folders.folder_listing(spark, tree, "last_modified > timestamp_ntz'2100-01-01'").isEmpty()
    assert {r.entity_type for r in folders.folder_listing(spark, tree, "target is not null and length(name) > 3 and name <> 'soft'").collect()} == {"Symlink"}


def test_the_plan_has_no_filter_left(spark, tree):
    folders.folder_listing(spark, tree)
    spark.conf.set(folders._PUSHDOWN, "true")
    plan = lambda c: spark.read.format("filtered_folder_listing").load(tree).where(c)._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert "Filter" not in plan("relative_path like 'a/b%' and size >= 0 and name in ('y', 'x')") and "Filter" in plan("length(name) > 1")
    spark.conf.set(folders._PUSHDOWN, "false")


def test_link_chains_end_or_are_null(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), *[(f"l{i}", f"l{i + 1}") for i in range(45)]], "link string, target string")
    got = {r.link: r.final for r in walk.resolved_links(links).collect()}
    assert (got["a"], got["b"], got["x"], got["l5"], got["l4"]) == ("c", "c", None, "l45", None)


def test_lists(spark, tmp_path):
    lines = spark.createDataFrame([("﻿a",), ("",), ("b/c",)], "value string")
    assert [r.path for r in scans.listed_paths(lines).collect()] == ["a", "b/c"]
    (tmp_path / "old").write_text('{\n"Files": ["a"]}')
    (tmp_path / "new").write_text("a\nb\n")
    scans.reject_json_list(spark, str(tmp_path / "new"))
    with pytest.raises(ValueError, match="old JSON"):
        scans.reject_json_list(spark, str(tmp_path / "old"))


def test_generator_codec_and_names(spark):
    assert scans.benchmark_from_url(scans.benchmark_to_url(5, 10, 2)) == (5, 10, 2)
    got = [r.relative_path for r in scans.generated(spark, 12345, 1).where("name in ('1', '01', '54321')").collect()]
    assert sorted(got) == ["01", "1", "54321"]


def test_readers_clean_what_they_read(spark, tmp_path):
    rows = spark.createDataFrame([("c", "a", "Folder", 9, "")], "container string, relative_path string, entity_type string, size long, md5 string")
    for kind in ("parquet", "json", "orc"):
        getattr(rows.write, kind)(str(tmp_path / kind))
        r = scans.open_inventory(spark, str(tmp_path / kind), kind).first()
        assert (r["size"], r.md5, r.container) == (0, None, "c")
    with pytest.raises(ValueError):
        scans.open_inventory(spark, "x", "nothing")


def test_chunks_cover_each_object_once(spark):
    sizes = [0, 1, (8 << 20) - 1, 8 << 20, (8 << 20) + 1, 10**11]
    rows = spark.createDataFrame([(str(s), s) for s in sizes], "name string, size long")
    for r in parts.chunks(rows).groupBy("name", "size").agg(F.sum("length").alias("sum"), F.min("length").alias("least"), F.count("*").alias("n"), F.max("chunk").alias("last")).collect():
        assert r["sum"] == r["size"] and r.last == r.n - 1 and (r.least > 0 or r["size"] == 0)


def test_numbering_is_dense_and_stable(spark):
    rows = spark.range(5000).select(F.lit("j").alias("job_id"), F.col("id").cast("string").alias("p"))
    a = {r.p: r.seq for r in parts.numbered(rows, ["job_id"], "p", ["p"]).collect()}
    b = {r.p: r.seq for r in parts.numbered(rows.repartition(7), ["job_id"], "p", ["p"]).collect()}
    assert a == b and sorted(a.values()) == list(range(5000))


def test_client_round_trip(spark, tmp_path):
    client = Client(spark, str(tmp_path / "plans"))
    source = client.inventory(scans.benchmark_to_url(100, 10, 3)).withColumn("container", F.lit("c"))
    plan = client.copy(source, "job-1", Filters(exclude=["1*"]), part_rows=16)
    client.store(plan)
    client.store(client.copy(source, "job-2"))
    assert {r.job_id: r.total for r in client.list_jobs().collect()} == {"job-1": plan.count(), "job-2": 100}
    assert client.job_summary("job-1").first().job_status == "InProgress" and client.list_jobs("Completed").count() == 0
    assert client.job_transfers("job-1", "NotStarted").count() == plan.count() and client.job_transfers("job-1", "Failed").count() == 0
    assert client.resume("job-2").count() == 100 and [r.job_id for r in client.remove("job-1").collect()] == ["job-1"] and client.clean(keep=["job-1"]).count() == 1
    assert client.sync(source, source, delete="true").where("action <> 'skip'").count() == 0
    assert client.list(source, ["size"]).columns == ["Path", "Size"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d41d8cd98f00b204e9800998ecf8427e")], "relative_path string, md5 string").withColumn("last_modified", F.current_timestamp())
    parts.write_hashes(rows, str(tmp_path / "h"))
    assert scans.hash_sidecar(spark.read.parquet(str(tmp_path / "h"))).first().hash == "d41d8cd98f00b204e9800998ecf8427e"
    log = spark.createDataFrame([("f", 0, "Body")], "name string, offset long, state string").withColumn("ts", F.current_timestamp())
    parts.write_chunk_log(log, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).columns == ["Name", "Offset", "State", "StateStartTime"]
    parts.measure(rows)
    assert parts.dry_run(rows).first().line.startswith('{"relative_path":"a"')


def test_percent(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (12, 10), (None, 10)], "done long, expected long")
    assert [r[0] for r in df.select(jobs.percent_complete(F.col("done"), F.col("expected"))).collect()] == [100.0, 50.0, 100.0, None]


@pytest.mark.parametrize("facts,status", [((0, 0, 1), "Completed"), ((1, 0, 1), "CompletedWithSkipped"), ((0, 1, 1), "CompletedWithErrors"), ((0, 1, 0), "Failed"), ((1, 1, 0), "CompletedWithErrorsAndSkipped"), ((0, 0, 0), "Completed")])
def test_job_status(spark, facts, status):
    assert spark.range(1).select(jobs.job_status(*[F.lit(bool(x)) for x in facts])).first()[0] == status


def test_reorder_waits_for_gaps(spark, tmp_path):
    def arrive(n, rows):
        spark.createDataFrame(rows, "name string, seq long").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    arrive(0, [("f", 2), ("f", 0), ("g", 1)])
    arrive(1, [("f", 1), ("f", 1)])
    stream = live.events_stream(spark, str(tmp_path / "in/*"), 1)
    got = live.run_to_table(live.in_sequence(stream), "append", str(tmp_path / "out")).collect()
    assert sorted(tuple(r) for r in got) == [("f", 0), ("f", 1), ("f", 2)]


def test_long_and_repeated_lists_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([("a/b/c", "File"), ("a/x", "File"), ("ab", "File"), ("d", "File")], "relative_path string, entity_type string")
    paths = spark.createDataFrame([("a",), ("a/b/",), ("d",), ("",)], "path string")
    want = [("a", "a/b/c"), ("a", "a/x"), ("a/b", "a/b/c"), ("d", "d")]
    found = lambda p: sorted((r.listed, r.relative_path) for r in scans.by_list(rows, p).collect())
    assert found(paths) == want and found(paths.limit(0)) == []
    assert found(paths.unionByName(paths.where("path = 'd'"))) == [*want, ("d", "d")]
    monkeypatch.setattr(scans, "SHORT_LIST", 2)
    assert found(paths) == want


def test_deep_trees_are_walked_to_their_end(spark):
    children = spark.range(1, 15).select((F.col("id") - 1).cast("string").alias("parent"), F.col("id").cast("string").alias("path"))
    roots = spark.createDataFrame([("0",)], "path string")
    cut = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  kept in memory
    assert walk.crawled(children, roots, cut).agg(F.max("level")).first()[0] == 14
    with pytest.raises(RuntimeError, match="deeper"):
        walk.crawled(children, roots, cut, most_levels=5)
    linked = children.unionByName(spark.createDataFrame([("3", "9"), ("14", "2")], "parent string, path string"))  # a second parent, a way back
    assert {r.path: r.level for r in walk.crawled(linked, roots, cut).collect()} == {str(k): min(k, k - 5 if k >= 9 else k) for k in range(15)}


def test_a_chain_of_ten_thousand_takes_fourteen_rounds(spark):
    rounds = []
    cut = lambda df: (rounds.append(1), spark.createDataFrame(df.toPandas(), df.schema))[1]
    chain = spark.range(1, 10_001).selectExpr("cast(id - 1 as string) as parent", "cast(id as string) as path")
    cycle = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("z", "off"), ("lost", "kid")], "parent string, path string")
    got = walk.crawled(chain.unionByName(cycle), spark.createDataFrame([("0",)], "path string"), cut).toPandas()
    assert len(got) == 10_001 and (got["path"].astype(int) == got["level"]).all()
    assert len(rounds) <= 3 + 15


def levels_by_hand(parent, root):
    found = {}
    for path in [root, *parent]:
        seen, at = [], path
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at == root:
            found[path] = len(seen)
    return found


def test_a_deep_tree_is_stored_about_as_often_as_it_has_rows(spark):
    """Doubling over all paths stored each of them once a round, ten times here."""
    rows = []
    cut = lambda df: (rows.append(len(x := df.toPandas())), spark.createDataFrame(x, df.schema))[1]
    chain = spark.range(1, 3_000).selectExpr("cast(id - 1 as string) as parent", "cast(id as string) as path")
    got = walk.crawled(chain, spark.createDataFrame([("0",)], "path string"), cut).toPandas()
    assert len(got) == 3_000 and (got["path"].astype(int) == got["level"]).all()
    assert sum(rows) <= 4 * 3_000


def test_trees_whose_paths_lie_far_from_their_parents(spark, monkeypatch):
    """Cycles, what hangs off them and off no root; also with paths that are numbers, and few neighbours at a time."""
    rng = random.Random(6)
    names = rng.sample(range(10**6), 900)
    parent = {p: names[max(0, i - rng.choice([1, 1, 2, 9]))] for i, p in enumerate(names) if 0 < i < 800}
    parent |= {p: names[800 + (i + 1) % 20] if i < 20 else names[800 + rng.randrange(i)] for i, p in enumerate(names[800:])}
    parent |= {names[890]: -1}
    want = levels_by_hand(parent, names[0])
    for kind, of in (("string", str), ("bigint", int)):
        children = spark.createDataFrame([(of(p), of(x)) for x, p in parent.items()], f"parent {kind}, path {kind}")
        got = walk.crawled(children, spark.createDataFrame([(of(names[0]),)], f"path {kind}")).collect()
        assert len(got) == len(want) and {int(r.path): r.level for r in got} == want
    monkeypatch.setattr(walk, "NEIGHBOURS", 50)
    rows = pd.DataFrame({"path": list(map(str, names)), "at": [None if (x := parent.get(p)) is None else str(x) for p in names]}).sort_values("path")
    out = pd.concat(walk._followed(iter(rows[k : k + 30] for k in range(0, len(rows), 30))))
    assert out["path"].is_unique and set(map(str, want)) <= set(out["path"])
    over = {r.path: (r.at, r.level) for r in out.itertuples()}
    for p, level in want.items():
        at, steps = over[str(p)]
        assert level == steps + (want[int(at)] if isinstance(at, str) else 0)


def test_stored_plans_open_one_jobs_folder(spark, tmp_path):
    plan = spark.createDataFrame([("ab-1", 0), ("cd-2", 0), ("c", 0)], "job_id string, part_num int")
    parts.write_plan(plan, str(tmp_path / "p"))
    found = scans.plan_scan(spark.read.parquet(str(tmp_path / "p")), "cd-2")
    assert [r.job_id for r in found.collect()] == ["cd-2"] and len(found.inputFiles()) >= 1
    assert "job_prefix" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert {r.job_id for r in scans.plan_scan(spark.read.parquet(str(tmp_path / "p")), "c").collect()} == {"c", "cd-2"}



def test_without_a_shared_folder_a_cluster_is_an_error():
    from types import SimpleNamespace

    from stowage.session import shared_folder

    session = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("local[4]")).startswith("/tmp") and shared_folder(session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(session(master))
