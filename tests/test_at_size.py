"""Queries on rows that only larger tables have, against their SQL; what grows with the tables is bounded."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stowage import catalog
from stowage.functions import descriptors
from stowage.functions import values as v
from stowage.llm import collocations, common
from stowage.operators import chunklog, patterns, reconcile
from stowage.operators import jobs as j
from stowage.plans import parts
from stowage.streaming import jobs, live

from .conftest import canonical


@pytest.fixture
def matches_sql(spark, sf, tmp_path):
    """Whether a query gives what its SQL gives when one table is changed."""

    def run(name, table, change):
        change(spark.read.parquet(f"{sf}/{table}.parquet")).write.parquet(f"{tmp_path}/{table}.parquet")
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        want = con.execute(catalog.SQL[name]).df()
        assert len(want) and canonical(got) == canonical(want)

    return run


def test_sizes_beyond_a_gibibyte(matches_sql, spark):
    matches_sql("human_sizes", "supplier", lambda d: d.withColumn("s_suppkey", F.col("s_suppkey") + 2045))
    size = lambda **how: spark.range(1).select(v.human_size(F.lit(2**40).cast("long"), **how)).first()[0]
    assert (size(), size(largest="GiB")) == ("1.00 TiB", "1024.00 GiB")


def test_chunks_of_sizes_that_no_double_holds(matches_sql):
    matches_sql("block_sizes", "part", lambda d: d.withColumn("p_partkey", F.col("p_partkey") + 163_800))


def test_quotients_of_large_numbers_are_exact(spark):
    n = 2**60 + 1
    assert spark.range(1).select(v.chunk_count(F.lit(n), F.lit(2**20), F.lit(2**20))).first()[0] == 2**40 + 1
    summary = spark.createDataFrame([("a", 3, 3 * 2**58 - 1)], "job_id string, files long, bytes_enumerated long")
    assert j.mean_file(summary).first().bytes_per_file == 2**58 - 1


@pytest.mark.parametrize("ms,mean", [([0.49, 2.09, 1.4, 0.02], 1), ([-0.5, -1.0, None], -1), ([-1.0, -3.0], -2), ([None], None)])
def test_a_whole_mean_stays_whole(spark, ms, mean):
    """The first four sum to 3.9999999999999996 as doubles."""
    rows = spark.createDataFrame([("u", "ok", x) for x in ms], "user string, outcome string, ms double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert chunklog.network_ratios(rows.coalesce(1), "user").first().mean_ms == mean


def test_lists_of_patterns_stay_tables(spark, monkeypatch):
    """More patterns than a task may hold; the same rows as by walking all of them."""
    draw = random.Random(3)
    word = lambda letters, n: "".join(draw.choice(letters) for _ in range(draw.randint(0, n)))
    globs = [word("ab", 3) + draw.choice("*?") + word("ab/*?", 2) + draw.choice("ab") for _ in range(60)] + ["a[ab]b", "a[", "\\*a", "ab", "", "?*", None]
    prefixes = ["bab", "b/", "*", None]
    texts = list({word("ab/*", 6) for _ in range(400)} | {"ab\n", "ab", ""}) + ["aab", "aab", None]
    table = lambda some: spark.createDataFrame([(x,) for x in some], "pattern string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, name string")
    monkeypatch.setattr(patterns, "MOST", 2)
    for g, p in ((globs, None), (None, prefixes), (globs, prefixes), (None, [""]), (["x*"], None)):
        known = patterns.Automaton([x for x in g or [] if x is not None], [x for x in p or [] if x is not None])
        got = patterns.marked(rows, "name", "fits", table(g) if g else None, table(p) if p else None).collect()
        assert sorted((r.id, r.fits) for r in got) == [(i, t is not None and known.matches(t)) for i, t in enumerate(texts)]
    with pytest.raises(ValueError, match="over 2 patterns"):
        patterns.marked(rows, "name", "fits", table(["*", "?", "?*"]))


class _Kept(dict):
    """What a stateful processor keeps, in place of a store; counts what is written."""

    written = 0

    def getValueState(self, name, *schema):  # noqa: N802
        return self.setdefault(name, _Kept())

    getMapState = getValueState  # noqa: N815

    def get(self, key=None):
        return dict.get(self, key)

    getValue = get  # noqa: N815

    def update(self, value):
        self.updateValue(None, value)

    def updateValue(self, key, value):  # noqa: N802
        self.written += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]


def test_waiting_chunks_share_entries():
    """10,000 chunks out of order take the state a few writes, and leave nothing behind."""
    store, run, order, out = _Kept(), jobs._Reorder(), list(range(10_000)), []
    random.Random(4).shuffle(order)
    run.init(store)
    for k in range(0, 10_000, 2_500):
        out += [r.seq for r in run.handleInputRows(("f",), iter([{"seq": x} for x in [*order[k : k + 2_500], order[0], None]]), None)]
        assert len(store["waiting"]) <= 3 and sum(int.from_bytes(b[0], "little").bit_count() for b in store["waiting"].values()) == store["at"][None][1]
    assert out == list(range(10_000)) and not store["waiting"] and store["waiting"].written <= 12


def test_a_state_that_stands_is_not_written_again():
    store, run = _Kept(), live._Machine()
    run.init(store)
    given = lambda *asked: [(r.old, r.new, r.refused) for r in run.handleInputRows(("t",), iter([{"ts": k, "event_id": 0, "status": s} for k, s in enumerate(asked)][::-1]), None)]
    assert given(1, -1, 2, 5, 2) == [(None, 0, 0), (0, 1, 0), (1, -1, 0), (-1, 5, 0), (5, 2, 0), (None, None, 1)]
    assert given(1, 5) == [(None, None, 2)] and store["now"] == {None: (2,)} and store["now"].written == 1


def test_waiting_reports_are_kept_by_cells(spark):
    run = live.PacedReport(spark, fast=60, slow=240, limit=10)
    run.arrive(spark.range(600).select(F.lit("a").alias("job_id"), F.timestamp_seconds(F.col("id") + 6000).alias("ts")))
    run.advance()
    left = run.state("waiting").count()
    reports = [(r.at, r.n, r.total) for r in run.finish().select(F.unix_seconds("at").alias("at"), "n", "total").orderBy("at").collect()]
    assert left <= 11 and reports == [(6060, 60, 60), (6300, 240, 300), (6540, 240, 540), (6780, 60, 600)]


def test_chunks_left_by_file(spark):
    """As by chunk, whatever the committed rows are; and without a row a chunk in any exchange."""
    files = spark.createDataFrame([("a", 25), ("b", 10), ("c", 11), ("d", 0), ("e", 0)], "name string, size long").withColumn("block", F.lit(10).cast("long"))
    done = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 20, 10), ("a", 5, 10), ("a", None, 10), ("b", 0, 10), ("e", 0, 0), ("x", 0, 10)], "name string, offset long, length long")
    cut = parts.chunks(files.select("name", "size"), F.lit(10).cast("long"))
    rows = lambda d: sorted(tuple(r) for r in d.select("name", "offset", "length").collect())
    got = reconcile.chunks_left(files, done, "name")
    assert rows(got) == rows(reconcile.uncommitted(cut, done)) == [("a", 10, 10), ("a", 20, 5), ("c", 0, 10), ("c", 10, 1), ("d", 0, 0)]


def test_shards_are_read_one_at_a_time(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(collocations, "staged", lambda df, name, *a, **k: kept.setdefault(name, common.staged(df, name, *a, **k)))
    docs = spark.range(40).select(F.lit("en").alias("lang"), F.lit("a b c d e f g h").alias("text")).coalesce(1)
    nodes, _, totals = collocations.frequent_nodes(docs, segment=30)
    assert totals.first().n == 320 and nodes.where("depth = 1").agg(F.min("f")).first()[0] == 40
    assert len(kept["tries"].inputFiles()) == kept["tries"].count() > 5


def test_plain_descriptors_need_no_walk(monkeypatch):
    text = "O:S-1-5-7G:SYD:PAI(A;OICI;FAFR;;;S-1-1-9)(A;;;;;BA)S:(AU;;;;;WD;x)"
    walked = descriptors._any(text)
    monkeypatch.setattr(descriptors, "_any", lambda t: None)
    assert descriptors.parsed(text) == walked and walked["sacl"]["entries"] == [["AU", "", "", "", "", "WD", "x"]]
    assert descriptors.parsed('O:"a"') is None  # left to the walk
