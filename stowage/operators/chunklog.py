"""What the states of chunks and the counters of requests tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States in the order that a report shows them, for each direction.
UPLOAD_STATES = ("RAM", "DiskIO", "Worker", "FilePacer", "Body", "Done")
DOWNLOAD_STATES = ("RAM", "Worker", "FilePacer", "HeaderResponse", "Body", "DiskIO", "Sorting", "PriorChunk", "QueueToWrite", "Done")
S2S_STATES = ("RAM", "Worker", "FilePacer", "S2SCopyOnWire", "Done")
STATES = {"upload": UPLOAD_STATES, "download": DOWNLOAD_STATES, "s2s": S2S_STATES}
SMALL_QUEUE, LONG_BODY_S = 10, 30
CHUNK = ("name", "offset")


def durations(log: DataFrame) -> DataFrame:
    """Each state's seconds, 0 for a chunk's last; long: a body of over half a minute, or one that was read again."""
    w = Window.partitionBy(*CHUNK).orderBy("ts")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    d = log.withColumn("next", F.lead("ts").over(w)).withColumn("seconds", F.coalesce((micros(F.col("next")) - micros(F.col("ts"))) / 1e6, F.lit(0.0)))
    is_long = ((F.col("state") == "Body") & (F.col("seconds") > LONG_BODY_S)) | F.col("state").startswith("BodyReRead")
    return d.withColumn("is_long", is_long).drop("next")


def slow_files(log: DataFrame) -> DataFrame:
    """All states of the files of which some chunk was long, with whether the chunk itself was."""
    d = durations(log)
    files = d.where("is_long").select("name").distinct()
    flagged = d.groupBy(*CHUNK).agg(F.bool_or("is_long").alias("chunk_is_long"))
    return d.join(files, "name", "left_semi").join(flagged, list(CHUNK))


def current_states(log: DataFrame) -> DataFrame:
    """Each chunk's last state."""
    return log.groupBy(*CHUNK).agg(F.max_by("state", F.struct("ts", "event_id") if "event_id" in log.columns else F.col("ts")).alias("state"))


def state_counts(states: DataFrame, direction: str) -> DataFrame:
    """Number of chunks in each state of a direction, in order, zeros too; bodies that are read again count as bodies."""
    names = states.sparkSession.createDataFrame(list(enumerate(STATES[direction])), "place int, state string")
    body = F.when(F.col("state").startswith("BodyReRead"), "Body").otherwise(F.col("state"))
    counts = states.groupBy(body.alias("state")).agg(F.count("*").alias("n"))
    return names.join(counts, "state", "left").select("place", "state", F.coalesce("n", F.lit(0)).alias("n"))


def primary_constraint(counts: DataFrame, direction: str, retries: int = 0, cpu_busy: bool = False) -> DataFrame:
    """What holds a job back, in order of suspicion. counts: state, n. retries: since the last look."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0))
    row = counts.agg(*[n(s).alias(s) for s in ("FilePacer", "Worker", "RAM", "DiskIO", "Sorting", "QueueToWrite")])
    disk_up = (F.col("RAM") + F.col("DiskIO") > 0) & (F.col("Worker") < SMALL_QUEUE)
    waiting = F.col("Sorting") + F.col("QueueToWrite")
    disk_down = (waiting > 10) & (waiting > 5 * F.col("Worker"))
    return row.select(
        F.when(F.col("FilePacer") >= SMALL_QUEUE, "PageBlobService")
        .when(F.lit(retries > 0), "Service")
        .when(F.lit(direction == "upload") & disk_up, "Disk")
        .when(F.lit(direction == "download") & disk_down, "Disk")
        .when(F.lit(cpu_busy), "CPU")
        .otherwise("Unknown")
        .alias("constraint")
    )


def network_ratios(requests: DataFrame, *keys: str) -> DataFrame:
    """Operations a second, shares of errors and of the kinds of throttling, whole mean ms. requests: ts, outcome, ms.

    outcome: ok, network_error, busy_iops, busy_throughput, busy_other. The mean's sum is of decimals, to the nanosecond,
    so a mean that is a whole number stays one whatever the order of rows.
    """
    ops = F.count("*")
    share = lambda c: F.round(F.when(ops > 0, 100.0 * F.count_if(c) / ops).otherwise(0.0), 6)
    o = F.col("outcome")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / 1e6
    total, timed = F.sum(F.col("ms").cast("decimal(28,6)")), F.count("ms")
    mean = F.call_function("div", total, timed) - F.when((total < 0) & (total % timed != 0), 1).otherwise(0)
    return requests.groupBy(*keys).agg(
        ops.alias("operations"),
        F.when(span > 0, F.floor(ops / span)).otherwise(0).cast("long").alias("iops"),
        share(o == "network_error").alias("network_error_pct"),
        share(o.startswith("busy")).alias("busy_pct"),
        share(o == "busy_iops").alias("busy_iops_pct"),
        share(o == "busy_throughput").alias("busy_throughput_pct"),
        share(o == "busy_other").alias("busy_other_pct"),
        F.when(timed > 0, mean).cast("long").alias("mean_ms"),
    )


def advice(ratios: DataFrame) -> DataFrame:
    """Advice codes of each row in order of weight, the first with priority.

    ratios: the shares of ``network_ratios`` and mbps, cap_mbps, concurrency_reason, cores, direction, to_files, bytes_per_file.
    Throttling in total adds up all three kinds.
    """
    iops, thru, other = F.col("busy_iops_pct"), F.col("busy_throughput_pct"), F.col("busy_other_pct")
    known = (iops > 1) | (thru > 1)
    busy = ~known & (iops + thru + other > 1)
    throttled = known | busy
    network = ~throttled & (F.col("network_error_pct") > 2)
    capped = (F.col("cap_mbps") > 0) & (F.col("mbps") > 0.9 * F.col("cap_mbps"))
    some = throttled | network | capped
    tuned = F.col("concurrency_reason")
    at_vm_limit = (F.col("cores") > 0) & (F.col("direction") != "s2s") & (F.col("mbps") >= F.col("cores") * 375)
    last = (
        F.when(some, "NetworkNotBottleneck")
        .when(tuned == "optimum", F.when(at_vm_limit, "VMSize").when(F.col("to_files"), "FileShareOrNetwork").when(F.col("bytes_per_file") <= 4 * 1024 * 1024, "SmallFilesOrNetwork").otherwise("NetworkIsBottleneck"))
        .when(tuned == "high_cpu", "ConcurrencyHighCpu")
        .when(tuned == "disabled", "ConcurrencyNotTuned")
        .when(tuned == "hit_max", "ConcurrencyHitUpperLimit")
        .otherwise("ConcurrencyNotEnoughTime")
    )
    codes = F.array(F.when(iops > 1, "AccountIOPS"), F.when(thru > 1, "AccountThroughput"), F.when(busy, "ServerBusy"), F.when(network, "NetworkErrors"), F.when(capped, "MbpsCapped"), last)
    return ratios.withColumn("codes", F.filter(codes, lambda c: c.isNotNull()))


def advice_rows(advised: DataFrame, *keys: str) -> DataFrame:
    return advised.select(*keys, F.posexplode("codes").alias("place", "code")).withColumn("priority", F.col("place") == 0)


def interval_rates(samples: DataFrame, *keys: str) -> DataFrame:
    """Megabits a second since the last sample, NULL for the first and where no time passed. samples: ts, bytes (a running total)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 1e6
    return samples.withColumn("mbps", F.round(F.when(gap > 0, (F.col("bytes") - F.lag("bytes").over(w)) * 8 / 1e6 / gap), 9))


def average_rate(samples: DataFrame, *keys: str) -> DataFrame:
    """Bytes a second from first to last sample; 0 without time between."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / 1e6
    return samples.groupBy(*keys).agg(F.round(F.when(span > 0, F.sum("value") / span).otherwise(0.0), 9).alias("rate"))


def mean_chunk_seconds(chunks: DataFrame, *keys: str) -> DataFrame:
    """Mean seconds of a chunk; with fewer than four, so long that nothing counts as slow."""
    return chunks.groupBy(*keys).agg(F.when(F.count("*") >= 4, F.round(F.avg("seconds"), 6)).otherwise(float(24 * 3600)).alias("mean_seconds"))


def contiguous(chunks: DataFrame, *keys: str) -> DataFrame:
    """Which chunks follow without a gap from offset 0. chunks: offset, length."""
    w = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.coalesce(F.sum("length").over(w), F.lit(0)) == F.col("offset")
    marked = chunks.withColumn("fits", fits)
    upto = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("ready", F.min(F.col("fits").cast("int")).over(upto) == 1).drop("fits")
