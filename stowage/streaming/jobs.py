"""The live forms of the summaries, as Structured Streaming.

Each function takes and gives a streaming DataFrame; run_to_table drives one through all the input there is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stowage.session import reachable


def events_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files as they come; files_per_trigger bounds what one batch takes on."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def live_summary(events: DataFrame) -> DataFrame:
    """Running counts of each job from completion events. Failed bytes stay expected, unlike in the rebuilt summary.

    events: job_id, status, size.
    """
    s = F.col("status")
    return events.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(s == 2).alias("completed"), F.count_if(s.isin(-1, -2, -5)).alias("failed"), F.count_if(s.isin(-3, -4)).alias("skipped"),
        F.sum(F.when(~s.isin(-3, -4), F.col("size")).otherwise(0)).alias("bytes_expected"), F.sum(F.when(s == 2, F.col("size")).otherwise(0)).alias("bytes_transferred"),
    )


def failure_feed(events: DataFrame) -> DataFrame:
    """Failed and skipped transfers as an append stream, in place of lists that are emptied when read."""
    return events.where("status <= -1")


def windowed_report(events: DataFrame, every: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Number and bytes in tumbling windows of event time. events: ts (timestamp), value."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "n", "value")


_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Chunks of one file that wait for an earlier one, at most: more is an error, as a full buffer is.
MOST_WAITING = 1_000_000


#: Chunks that one entry of the state stands for, a bit each.
BLOCK = 4096


class _Reorder(StatefulProcessor):
    """State of a file: the next number, how many wait, and those that wait as bits, an entry for each BLOCK numbers, gone once given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, waiting long")
        self.waiting = handle.getMapState("waiting", "block long", "bits binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        following, waiting = self.at.get() or (0, 0)
        blocks: dict[int, int] = {}

        def load(block: int) -> int:
            if block not in blocks:
                kept = self.waiting.getValue((block,)) if waiting else None
                blocks[block] = int.from_bytes(kept[0], "little") if kept else 0
            return blocks[block]

        first, before = following, waiting
        for seq in {r["seq"] for r in rows}:
            if seq is not None and seq >= following:
                bits, bit = load(seq // BLOCK), 1 << seq % BLOCK
                waiting += not bits & bit
                blocks[seq // BLOCK] = bits | bit
        touched = set(blocks)
        while load(following // BLOCK) >> following % BLOCK & 1:
            blocks[following // BLOCK] ^= 1 << following % BLOCK
            touched.add(following // BLOCK)
            following += 1
        waiting -= following - first
        for block in touched:
            if blocks[block]:
                self.waiting.updateValue((block,), (blocks[block].to_bytes(BLOCK // 8, "little"),))
            elif before:
                self.waiting.removeKey((block,))
        if waiting > MOST_WAITING:
            raise ValueError(f"{waiting} chunks of {key[0]} wait for chunk {following}")
        self.at.update((following, waiting))
        for seq in range(first, following):
            yield Row(name=key[0], seq=seq)

    def close(self) -> None:
        pass


def in_sequence(chunks: DataFrame) -> DataFrame:
    """T4, T5, O3: each file's chunks by number, as soon as all before them are there.

    chunks: name, seq (0, 1, ...). A chunk that comes twice is given once. State lies in RocksDB and grows with the
    chunks that wait, never with those given; more than MOST_WAITING of one file end the query.
    """
    reachable(chunks.sparkSession)
    return chunks.groupBy("name").transformWithState(_Reorder(), "name string, seq long", "Append", "None")


def standing_status(events: DataFrame) -> DataFrame:
    """T6, T7 live: the first locked status of each transfer. events: job_id, ts, status."""
    locked = (F.col("status") <= -1) | (F.col("status") == 2)
    return events.where(locked).groupBy("job_id").agg(F.min_by("status", F.struct("ts", "event_id")).alias("status"))


def since(rows: DataFrame, previous_start: str) -> DataFrame:
    """What an incremental run looks at: changed since five seconds before the last start."""
    return rows.where(F.col("last_modified") >= F.lit(previous_start).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(5)))


def run_to_table(stream: DataFrame, mode: str, folder: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Takes all the input there is and gives the result as a table. complete: the last batch's; append: all batches' rows."""
    spark = stream.sparkSession
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/part={number}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{base}/out").drop("batch", "part")
