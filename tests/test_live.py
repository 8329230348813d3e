import pytest
from pyspark.sql import functions as F

from stowage.streaming import live


def parts_of(rows):
    return sorted((r.job_id, r.part_num, r.n, r.final) for r in rows.groupBy("job_id", "part_num").agg(F.count("*").alias("n"), F.max("is_final").alias("final")).collect())


def test_parts_are_cut_while_rows_arrive_and_after_a_restart(spark):
    rows = spark.range(95).selectExpr("if(id < 60, 'hot', 'small') as job_id", "cast(id as string) as path")
    run = live.PartsOfArrivals(spark, rows.schema, part_rows=10, lanes=2)
    for k in range(3):
        run.arrive(rows.where(f"path % 3 = {k}"))
        live.PartsOfArrivals(spark, rows.schema, part_rows=10, lanes=2, folder=run.folder).advance()  # as after a restart
        done = run.written(run.PARTS)
        assert all(n == 10 and not final for _, _, n, final in parts_of(done))
    assert not done.isEmpty()
    want = [("hot", k, 10, k == 5) for k in range(6)] + [("small", k, min(10, 35 - 10 * k), k == 3) for k in range(4)]
    assert parts_of(run.finish()) == want
    assert run.finish().select("row").distinct().count() == 95


def test_states_move_and_locked_ones_refuse(spark):
    run = live.StateMachine(spark)
    event = lambda name, *statuses: [(name, s, k) for k, s in enumerate(statuses)]
    first = [*event("a", 1, 2, -1, 5), *event("b", -1, 1, 2), *event("c", 1)]
    second = [*event("b", 5, 1), *event("c", -3, 2, 5, 2), *event("d", 1, 1)]
    seen = []
    for rows in (first, second):
        run.arrive(spark.createDataFrame(rows, "name string, status int, event_id long").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id)")).select("name", "status", "ts", "event_id"))
        run.advance()
        from_moves = {r.status: r.n for r in run.counters().collect()}
        assert from_moves == {r.status: r["count"] for r in run.standing().groupBy("status").count().collect()}
        seen.append({r.name: r.status for r in run.standing().collect()})
    assert seen == [{"a": 2, "b": -1, "c": 1}, {"a": 2, "b": 1, "c": 2, "d": 1}]
    assert run.written(run.COUNTS).agg(F.sum("refused")).first()[0] == 2 + 2 + 1


def test_bookmarks_lose_and_repeat_nothing(spark, tmp_path):
    row = lambda path, at: ("c", path, f"2024-01-01 00:{at}")
    table = lambda *rows: spark.createDataFrame(rows, "container string, relative_path string, at string").select("container", "relative_path", F.col("at").cast("timestamp_ntz").alias("last_modified"))
    runs = live.BookmarkedRuns(spark, str(tmp_path / "runs"))
    first = [row("a", "00:10"), row("b", "09:58")]
    assert runs.run(table(*first), "2024-01-01 00:10:00") == 0
    second = [*first, row("late", "09:57"), row("c", "10:30")]
    with pytest.raises(Exception, match="lost"):
        runs.run(table(*second), "2024-01-01 00:20:00", lambda d: d.withColumn("x", F.raise_error(F.lit("lost")).cast("int")))
    assert runs.last() == 0
    assert runs.run(table(*second, row("b", "25:00")), "2024-01-01 00:30:00") == 1
    assert sorted(r.relative_path for r in runs.rows_of(1).collect()) == ["b", "c", "late"]
    assert runs.changed(table(*second)).isEmpty()


def test_reports_slow_down(spark):
    run = live.PacedReport(spark, fast=2, slow=10, limit=3)
    event = lambda job, *seconds: [(job, s) for s in seconds]
    arrivals = [[*event("a", 1000, 1001, 1003), *event("b", 1003)], [*event("a", 1004, 1005, 1006, 1007, 1025), *event("b", 1006)], event("a", 1026, 1041)]
    for rows in arrivals:
        run.arrive(spark.createDataFrame(rows, "job_id string, s long").select("job_id", F.timestamp_seconds("s").alias("ts")))
        run.advance()
    got = [(r.job_id, r.at, r.n, r.total) for r in run.finish().select("job_id", F.unix_seconds("at").alias("at"), "n", "total").collect()]
    # Above three events the pace is ten seconds from the last report, at 1006.
    assert sorted(got) == [("a", 1002, 2, 2), ("a", 1004, 1, 3), ("a", 1006, 2, 5), ("a", 1016, 2, 7), ("a", 1026, 1, 8), ("a", 1036, 1, 9), ("a", 1046, 1, 10), ("b", 1004, 1, 1), ("b", 1008, 1, 2)]
