"""Runs that go on while input arrives: parts cut while the scan continues, states that move, state read on request, bookmarks.

Each run is a folder with a checkpoint and its tables. ``advance`` takes what has arrived; it can be called again after
a stop or a failure, since every batch overwrites its own rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from stowage.plans.parts import PART_ROWS
from stowage.session import reachable, scratch

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lanes that a job's rows are cut in, so that a job with most of the rows is no single task.
LANES = 64
#: Statuses: done, started anew; failures are negative.
DONE, RESTARTED = 2, 5


class LiveRun:
    """A stream driven by hand: each ``advance`` takes all that has arrived in ``arrivals`` since the last."""

    def __init__(self, spark: SparkSession, schema: T.StructType | str, folder: str | None = None):
        self.spark, self.schema = reachable(spark), schema
        self.folder = (folder or scratch(spark, "live")).rstrip("/")
        self.arrivals, self.checkpoint, self.out = f"{self.folder}/arrivals", f"{self.folder}/checkpoint", f"{self.folder}/out"

    def arrive(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.arrivals)

    def transformed(self, rows: DataFrame) -> DataFrame:
        return rows

    def batch_rows(self, rows: DataFrame, number: int) -> DataFrame:
        return rows

    def advance(self, files_per_batch: int | None = None) -> None:
        reader = self.spark.readStream.schema(self.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        before = self.spark.conf.get(_STORE, None)
        self.spark.conf.set(_STORE, _ROCKS)

        def write(batch: DataFrame, number: int) -> None:
            self.batch_rows(batch, number).write.mode("overwrite").parquet(f"{self.out}/batch={number}")

        try:
            query = self.transformed(reader.parquet(self.arrivals)).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            self.spark.conf.unset(_STORE) if before is None else self.spark.conf.set(_STORE, before)

    def written(self, columns: T.StructType | str) -> DataFrame:
        """All batches' rows, with their batch. columns: what a batch writes."""
        schema = T.StructType.fromDDL(columns) if isinstance(columns, str) else columns
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(self.out)

    def state(self, variable: str) -> DataFrame:
        """A state variable as the last batch has left it, read without disturbing the run."""
        before = self.spark.conf.get(_STORE, None)
        self.spark.conf.set(_STORE, _ROCKS)
        try:
            return self.spark.read.format("statestore").option("stateVarName", variable).load(self.checkpoint)
        finally:
            self.spark.conf.unset(_STORE) if before is None else self.spark.conf.set(_STORE, before)


class _Cut(StatefulProcessor):
    """A lane of a job: what waits for a part to fill. A full part goes once a further row is there, so the last one never goes."""

    def __init__(self, part_rows: int):
        self.part_rows = part_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "row string")
        self.at = handle.getValueState("at", "nth long, waits long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        nth, waits = self.at.get() if self.at.exists() else (0, 0)
        new = [r for batch in rows for r in batch["row"]]
        if waits + len(new) <= self.part_rows:
            self.waiting.appendList([(r,) for r in new])
            self.at.update((nth, waits + len(new)))
            return
        everything = ([r[0] for r in self.waiting.get()] if waits else []) + new
        parts = (len(everything) - 1) // self.part_rows
        for k in range(parts):
            own = everything[k * self.part_rows : (k + 1) * self.part_rows]
            yield pd.DataFrame({"job_id": key[0], "lane": int(key[1]), "nth": nth + k, "row": own})
        rest = everything[parts * self.part_rows :]
        self.waiting.put([(r,) for r in rest])
        self.at.update((nth + parts, len(rest)))

    def close(self) -> None:
        pass


class PartsOfArrivals(LiveRun):
    """Parts of exactly ``part_rows`` rows are there while the listing goes on; ``finish`` cuts what is left, the last part final.

    Rows: job_id and whatever else, carried as JSON. Lanes fill parts of their own; what the lanes have left at the end,
    less than a part each, is numbered together, so parts are as many and as large as those of a finished listing.
    """

    PARTS = "job_id string, part_num long, is_final boolean, row string"

    def __init__(self, spark: SparkSession, schema: T.StructType | str, part_rows: int = PART_ROWS, lanes: int = LANES, folder: str | None = None):
        super().__init__(spark, schema, folder)
        self.part_rows, self.lanes = part_rows, lanes

    def transformed(self, rows: DataFrame) -> DataFrame:
        row = F.to_json(F.struct(*[c for c in rows.columns if c != "job_id"]))
        dealt = rows.select(F.col("job_id").cast("string").alias("job_id"), row.alias("row")).withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(self.lanes)).cast("long"))
        return dealt.groupBy("job_id", "lane").transformWithStateInPandas(_Cut(self.part_rows), "job_id string, lane long, nth long, row string", "Append", "None")

    def batch_rows(self, rows: DataFrame, number: int) -> DataFrame:
        """Numbers the batch's parts after those of the batches before it."""
        own = rows.groupBy("job_id", "lane", "nth").agg(F.count("*").alias("n"))
        place = own.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("lane", "nth")) - 1)
        if number:
            before = self.written(self.PARTS).where(F.col("batch") < number).groupBy("job_id").agg((F.max("part_num") + 1).alias("first"))
            place = place.join(before, "job_id", "left")
        else:
            place = place.withColumn("first", F.lit(0))
        numbered = place.select("job_id", "lane", "nth", (F.coalesce("first", F.lit(0)) + F.col("place")).cast("long").alias("part_num"))
        return rows.join(numbered, ["job_id", "lane", "nth"]).select("job_id", "part_num", F.lit(False).alias("is_final"), "row")

    def finish(self) -> DataFrame:
        """All parts: job_id, part_num, is_final, row."""
        full = self.written(self.PARTS).select("job_id", "part_num", "is_final", "row")
        left = self.state("waiting").select(F.col("key.job_id").alias("job_id"), F.col("key.lane").alias("lane"), F.col("list_element.row").alias("row"))
        lanes = left.groupBy("job_id", "lane").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("job_id").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = lanes.select("job_id", "lane", before.alias("before"), F.sum("n").over(Window.partitionBy("job_id")).alias("all"))
        place = F.row_number().over(Window.partitionBy("job_id", "lane").orderBy("row")) - 1  # of a lane, a part at most
        after = full.groupBy("job_id").agg((F.max("part_num") + 1).alias("first"))
        last = left.withColumn("place", place).join(starts, ["job_id", "lane"]).join(after, "job_id", "left").withColumn("own", F.floor((F.col("before") + F.col("place")) / self.part_rows))
        final = F.col("own") == F.floor((F.col("all") - 1) / self.part_rows)
        return full.unionByName(last.select("job_id", (F.coalesce("first", F.lit(0)) + F.col("own")).cast("long").alias("part_num"), final.alias("is_final"), "row"))


def moved(status: Column, asked: Column) -> Column:
    """T6, T9, as a Column: the status after a request. Done stays; a failure or a cancellation moves only by a restart."""
    return F.when(status == DONE, status).when((status <= -1) & (asked != RESTARTED), status).otherwise(asked)


class _Machine(StatefulProcessor):
    """A transfer's status. Gives each move that is made: where from, where to."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "status int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.now.get()
        first = status = known[0] if known else 0
        if not known:
            yield Row(name=key[0], old=None, new=0, refused=0)
        refused = 0
        last = lambda x: (x is None, 0 if x is None else x)
        for _, _, new in sorted((last(r["ts"]), last(r["event_id"]), r["status"]) for r in rows):
            if status == DONE or (status <= -1 and new != RESTARTED):
                refused += 1
            elif new != status:
                yield Row(name=key[0], old=status, new=new, refused=0)
                status = new
        if not known or status != first:
            self.now.update((status,))
        if refused:
            yield Row(name=key[0], old=None, new=None, refused=refused)

    def close(self) -> None:
        pass


class StateMachine(LiveRun):
    """Each transfer's status moves by its events; counters by status follow from the moves, batch by batch.

    Events: name, status, ts, event_id. A batch's events are taken in the order of (ts, event_id).
    """

    COUNTS = "status int, moved long, refused long"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        super().__init__(spark, "name string, status int, ts timestamp_ntz, event_id long", folder)

    def transformed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("name").transformWithState(_Machine(), "name string, old int, new int, refused long", "Append", "None")

    def batch_rows(self, rows: DataFrame, number: int) -> DataFrame:
        """What the batch changes: a row a status, so the counters' table grows with batches and statuses only."""
        ends = F.array(F.struct(F.col("old").alias("status"), F.lit(-1).alias("d")), F.struct(F.col("new").alias("status"), F.lit(1).alias("d")))
        sides = rows.select("refused", F.explode(ends).alias("e")).select("e.status", "e.d", "refused")
        return sides.groupBy("status").agg(F.sum("d").cast("long").alias("moved"), F.floor(F.sum("refused") / 2).cast("long").alias("refused"))

    def counters(self) -> DataFrame:
        """status, n after the last batch."""
        return self.written(self.COUNTS).where("status is not null").groupBy("status").agg(F.sum("moved").alias("n")).where("n <> 0")

    def standing(self) -> DataFrame:
        """name, status of every transfer, from the state itself."""
        return self.state("now").select(F.col("key.name").alias("name"), F.col("value.status").alias("status"))


class BookmarkedRuns:
    """Incremental runs that each take what has changed since the last, with their bookmark in the same commit.

    A run's rows and its start are written aside and put in place by one rename, so a run that fails leaves no bookmark
    and the next takes its rows too. Rows changed in the five seconds before the last start are looked at again, as a
    store's times may lag; those that the last run had are left out. Rows: container, relative_path, last_modified.
    """

    OVERLAP = 5

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _hadoop(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def last(self) -> int | None:
        files, top = self._hadoop(self.folder)
        names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        return max((int(n[4:]) for n in names if n.startswith("run=")), default=None)

    def rows_of(self, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/run={run}/rows")

    def changed(self, rows: DataFrame) -> DataFrame:
        """What the next run takes."""
        run = self.last()
        if run is None:
            return rows
        start = self.spark.read.parquet(f"{self.folder}/run={run}/bookmark").first()["started"]
        since = F.lit(start) - F.make_dt_interval(secs=F.lit(self.OVERLAP))
        had = self.rows_of(run).where(F.col("last_modified") >= since).select("container", "relative_path", "last_modified")
        return rows.where(F.col("last_modified") >= since).join(had, ["container", "relative_path", "last_modified"], "left_anti")

    def run(self, rows: DataFrame, started: str, result: Callable[[DataFrame], DataFrame] = lambda d: d) -> int:
        """Takes what has changed, stores its result and the bookmark at once; the run's number. Only one of two runs at a time is committed."""
        number = (self.last() if self.last() is not None else -1) + 1
        aside = f"{self.folder}/_run-{number}-{uuid.uuid4().hex}"
        result(self.changed(rows)).write.parquet(f"{aside}/rows")
        self.spark.range(1).select(F.lit(started).cast("timestamp_ntz").alias("started")).write.parquet(f"{aside}/bookmark")
        files, path = self._hadoop(aside)
        target = self._hadoop(f"{self.folder}/run={number}")[1]
        if files.exists(target) or not files.rename(path, target):
            raise RuntimeError(f"run {number} was committed by another")
        return number


class _Paced(StatefulProcessor):
    """A job's reports: every ``fast`` seconds, every ``slow`` once more than ``limit`` events are told.

    Every report is due at a multiple of what divides both paces, so waiting events are counts by such cells of time, not
    by second.
    """

    def __init__(self, fast: int, slow: int, limit: int):
        self.fast, self.slow, self.limit, self.cell = fast, slow, limit, gcd(fast, slow)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "at long, total long")
        self.waiting = handle.getMapState("waiting", "cell long", "n long")

    def _due(self, cell: int, at: int, total: int) -> int:
        """The second of the next report: the first on the job's grid that is after an event of this cell."""
        pace = self.slow if total > self.limit else self.fast
        return at + ((cell * self.cell - at) // pace + 1) * pace

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        counts: dict[int, int] = {}
        for batch in rows:
            for cell, n in (batch["second"] // self.cell).value_counts().items():
                counts[int(cell)] = counts.get(int(cell), 0) + int(n)
        for cell, n in counts.items():
            before = self.waiting.getValue((cell,))[0] if self.waiting.containsKey((cell,)) else 0
            self.waiting.updateValue((cell,), (before + n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self._due(min(k[0] for k in self.waiting.keys()), *(self.told.get() or (0, 0))) * 1000)
        yield pd.DataFrame({"job_id": pd.Series([], dtype=object), "at": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"), "total": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, now = [], timerValues.getCurrentWatermarkInMs()
        waiting = sorted((k[0], n[0]) for k, n in self.waiting.iterator())
        (at, total), i = self.told.get() or (0, 0), 0
        while i < len(waiting) and (due := self._due(waiting[i][0], at, total)) * 1000 <= now:
            n = 0
            while i < len(waiting) and waiting[i][0] * self.cell < due:
                self.waiting.removeKey((waiting[i][0],))
                n += waiting[i][1]
                i += 1
            at, total = due, total + n
            out.append((key[0], at, n, total))
        if out:
            self.told.update((at, total))
        if i < len(waiting):
            self.handle.registerTimer(self._due(waiting[i][0], at, total) * 1000)
        yield pd.DataFrame(out, columns=["job_id", "at", "n", "total"]).astype({"at": "int64", "n": "int64", "total": "int64"})

    def close(self) -> None:
        pass


class PacedReport(LiveRun):
    """Reports of a job's progress that slow down: every two seconds, every two minutes above a million transfers.

    Events: job_id, ts. A report is due once the watermark has passed it, which follows the latest event by ``late``: an
    event that comes later than that is in no report, as Spark's watermarks have it. Reports without news are left out.
    ``finish`` moves the watermark past the last event.
    """

    REPORTS = "job_id string, at long, n long, total long"
    _LAST = ""

    def __init__(self, spark: SparkSession, fast: int = 2, slow: int = 120, limit: int = 1_000_000, late: str = "10 seconds", folder: str | None = None):
        super().__init__(spark, "job_id string, ts timestamp", folder)
        self.fast, self.slow, self.limit, self.late = fast, slow, limit, late

    def transformed(self, rows: DataFrame) -> DataFrame:
        timed = rows.withWatermark("ts", self.late).withColumn("second", F.unix_seconds("ts"))
        return timed.groupBy("job_id").transformWithStateInPandas(_Paced(self.fast, self.slow, self.limit), self.REPORTS, "Append", "EventTime")

    def finish(self) -> DataFrame:
        """job_id, at (when), n since the report before, total."""
        self.arrive(self.spark.sql(f"select '{self._LAST}' as job_id, timestamp'2200-01-01' as ts"))
        self.advance()
        reports = self.written(self.REPORTS).where(F.col("job_id") != self._LAST)
        return reports.select("job_id", F.timestamp_seconds("at").alias("at"), "n", "total")
