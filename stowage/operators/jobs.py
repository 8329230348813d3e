"""What transfers add up to, by part and by job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED = (-1, -2, -5)
SKIPPED = (-3, -4)


def job_status(skipped: Column, failed: Column, succeeded: Column) -> Column:
    """The outcome of a finished job from three facts."""
    return (
        F.when(failed & skipped, "CompletedWithErrorsAndSkipped")
        .when(failed & succeeded, "CompletedWithErrors")
        .when(failed, "Failed")
        .when(skipped, "CompletedWithSkipped")
        .otherwise("Completed")
    )


def percent_complete(done: Column, expected: Column) -> Column:
    """100 where nothing is expected, never more than 100; NULL stays NULL."""
    ratio = 100.0 * done / F.nullif(expected, F.lit(0))
    return F.when(expected == 0, 100.0).when(ratio > 100, 100.0).otherwise(ratio)


def with_active_bytes(done: Column, active: Column, expected: Column) -> Column:
    """Bytes in flight count only as far as all together don't pass what is expected."""
    return F.when(done + active <= expected, done + active).otherwise(done)


def job_summary(transfers: DataFrame, *keys: str) -> DataFrame:
    """A5: the summary of each job from its planned rows. transfers: entity_type, size, status, and the keys.

    Failed and skipped bytes are not expected any more; the live form in ``streaming`` keeps failed ones.
    """
    s, size = F.col("status"), F.col("size")
    kind = lambda k: F.count_if(F.col("entity_type") == k)
    out = transfers.groupBy(*(keys or ("job_id",))).agg(
        F.count("*").alias("total"),
        kind("File").alias("files"),
        kind("Folder").alias("folders"),
        kind("Symlink").alias("symlinks"),
        kind("Hardlink").alias("hardlinks"),
        F.count_if(s == 2).alias("completed"),
        F.count_if(s.isin(*FAILED)).alias("failed"),
        F.count_if(s.isin(*SKIPPED)).alias("skipped"),
        F.sum(size).alias("bytes_enumerated"),
        F.sum(F.when(~s.isin(*FAILED, *SKIPPED), size).otherwise(0)).alias("bytes_expected"),
        F.sum(F.when(s == 2, size).otherwise(0)).alias("bytes_transferred"),
        F.bool_and(s.isin(2, *FAILED, *SKIPPED, -6)).alias("all_done"),
    )
    done = job_status(F.col("skipped") > 0, F.col("failed") > 0, F.col("completed") > 0)
    return out.withColumn("percent", F.round(percent_complete(F.col("bytes_transferred"), F.col("bytes_expected")), 6)).withColumn("job_status", F.when(F.col("all_done"), done).otherwise("InProgress"))


def failures(transfers: DataFrame) -> DataFrame:
    """The lists of failed and skipped transfers beside the summary: rows, not one long list a job."""
    return transfers.where(F.col("status").isin(*FAILED, *SKIPPED))


def part_counters(transfers: DataFrame) -> DataFrame:
    """Counters of each part; hard links that come later carry no bytes."""
    s, k = F.col("status"), F.col("entity_type")
    return transfers.groupBy("job_id", "part_num").agg(
        F.count("*").alias("total"),
        F.count_if(k == "File").alias("files"),
        F.count_if(k == "Folder").alias("folders"),
        F.sum(F.when(k == "Hardlink", 0).otherwise(F.col("size"))).alias("bytes"),
        F.count_if(s == 2).alias("completed"),
        F.count_if(s.isin(*FAILED)).alias("failed"),
        F.count_if(s.isin(*SKIPPED)).alias("skipped"),
        F.count_if(s.isin(2, *FAILED, *SKIPPED, -6)).alias("done"),
    )


def rolled_up(parts: DataFrame, final_parts: DataFrame) -> DataFrame:
    """Jobs from their parts' counters; complete when the final part was ordered and all parts are done. final_parts: job_id, part_num."""
    marked = parts.join(final_parts.withColumn("final", F.lit(True)), ["job_id", "part_num"], "left")
    return marked.groupBy("job_id").agg(
        F.count("*").alias("parts"), F.sum("total").alias("total"), F.sum("bytes").alias("bytes"), F.sum("completed").alias("completed"), F.sum("failed").alias("failed"), F.sum("skipped").alias("skipped"),
        (F.bool_or(F.coalesce("final", F.lit(False))) & F.bool_and(F.col("done") == F.col("total"))).alias("complete"),
    )


def links_may_start(parts: DataFrame) -> DataFrame:
    """A10: whether all parts of a job that aren't hard links are done. parts: job_id, part_class, total, done."""
    return parts.groupBy("job_id").agg(F.coalesce(F.bool_and(F.when(F.col("part_class") == 0, F.col("done") == F.col("total"))), F.lit(True)).alias("links_may_start"))


def printed_counts(summary: DataFrame) -> DataFrame:
    """Files alone, and a line of text."""
    files = F.col("total") - F.col("folders") - F.col("hardlinks")
    line = F.format_string("%d done, %d failed, %d skipped of %d", "completed", "failed", "skipped", "total")
    return summary.select("job_id", files.alias("files_only"), line.alias("line"))


def mean_file(summary: DataFrame) -> DataFrame:
    """Average bytes of a file; 0 without files."""
    return summary.select("job_id", F.when(F.col("files") > 0, F.call_function("div", F.col("bytes_enumerated"), F.col("files"))).otherwise(0).cast("long").alias("bytes_per_file"))


def deletable_folders(rows: DataFrame) -> DataFrame:
    """For every folder above a row, its number of descendants and whether it may go: all of them were deleted.

    rows: container, relative_path, deleted. Each row is laid out over its ancestors, so the cascade is one aggregate.
    """
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inner = rows.where(F.col("relative_path").contains("/")).withColumn("folder", F.explode(above))
    return inner.groupBy("container", "folder").agg(F.count("*").alias("descendants"), F.bool_and("deleted").alias("deletable"))


def first_locked(events: DataFrame, *keys: str) -> DataFrame:
    """Of each transfer's events the first locked status stands, else the last; the first error code that isn't 0 stands."""
    locked = (F.col("status") <= -1) | (F.col("status") == 2)
    order = F.struct("ts", "event_id")
    return events.groupBy(*keys).agg(
        F.coalesce(F.min_by(F.when(locked, F.col("status")), F.when(locked, order)), F.max_by("status", order)).alias("status"),
        F.coalesce(F.min_by("error_code", F.when(F.col("error_code") != 0, order)), F.lit(0)).alias("error_code"),
    )


#: A folder's states in their order.
FOLDER_STATES = ("unseen", "existed", "created", "registered")


def folder_states(events: DataFrame) -> DataFrame:
    """How far each folder has come: the furthest of its states. events: folder, state."""
    order = F.array_position(F.array(*map(F.lit, FOLDER_STATES)), F.col("state"))
    return events.groupBy("folder").agg(F.max_by("state", order).alias("state"))
