"""The library's front: what a user calls, each giving a DataFrame and changing nothing that it looks at."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from stowage.operators import jobs, predicates, projections, reconcile
from stowage.plans import parts
from stowage.schemas import SCHEMA_VERSION
from stowage.sources.scans import open_inventory, plan_scan

log = logging.getLogger("stowage")


class Client:
    """Plans and analyses over a session and a folder of stored plans."""

    def __init__(self, spark: SparkSession, plans: str | None = None, on_progress: Callable[[dict], None] | None = None):
        """on_progress: is called with each line of a summary that a call has made."""
        self.spark, self.plans, self.on_progress = spark, plans, on_progress

    def inventory(self, uri: str, kind: str | None = None, recursive: bool = True) -> DataFrame:
        return open_inventory(self.spark, uri, kind, recursive)

    def copy(self, source: DataFrame, job_id: str, filters: predicates.Filters | None = None, policy: Column | None = None, part_rows: int = parts.PART_ROWS) -> DataFrame:
        """A copy's plan: filtered, projected, in parts."""
        f = filters or predicates.Filters()
        rows = source.where(f.column())
        chosen = policy if policy is not None else predicates.entity_policy(folders=f.folder_option())
        plan = projections.to_transfers(rows, chosen).withColumn("job_id", F.lit(job_id)).withColumn("target_hardlink", F.lit(None).cast("string"))
        return parts.in_parts(plan, "source", ["container", "source"], part_rows).withColumn("status", F.lit(0)).withColumn("error_code", F.lit(0))

    def sync(self, source: DataFrame, destination: DataFrame, **options) -> DataFrame:
        return reconcile.sync_plan(source, destination, **options)

    def list(self, rows: DataFrame, properties: list[str]) -> DataFrame:
        return projections.listing(rows, properties)

    def counted(self, rows: DataFrame, *keys: str) -> DataFrame:
        """The rows, once their counts by a few keys have gone to the handler: a line for each key, however many the rows."""
        if self.on_progress:
            for line in rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).toLocalIterator():
                self.on_progress(line.asDict())
        return rows

    def store(self, plan: DataFrame) -> None:
        if not self.plans:
            raise ValueError("no folder for plans")
        parts.write_plan(plan, self.plans)

    def _stored(self, job: str = "") -> DataFrame:
        return plan_scan(self.spark.read.parquet(self.plans), job, SCHEMA_VERSION)

    def list_jobs(self, status: str = "All") -> DataFrame:
        found = jobs.job_summary(self._stored())
        return found if status.lower() == "all" else found.where(F.lower("job_status") == status.lower())

    def job_summary(self, job: str) -> DataFrame:
        return jobs.job_summary(self._stored(job).where(F.col("job_id") == job))

    def job_transfers(self, job: str, status: str = "All") -> DataFrame:
        return self._stored(job).where((F.col("job_id") == job) & predicates.with_status(status))

    def resume(self, job: str) -> DataFrame:
        return parts.resumed(self._stored(job).where(F.col("job_id") == job))

    def clean(self, keep: list[str] | None = None) -> DataFrame:
        return parts.history_to_delete(self._stored().select("job_id").distinct(), keep=keep)

    def remove(self, job: str) -> DataFrame:
        return parts.history_to_delete(self._stored().select("job_id").distinct(), job=job)


class ProgressLog(StreamingQueryListener):
    """A stream's progress as log lines."""

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        log.info("batch %s: %s rows, %s rows a second", p.get("batchId"), p.get("numInputRows"), p.get("processedRowsPerSecond"))

    def onQueryIdle(self, event) -> None:
        log.debug("stream %s idle", event.id)

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended: %s", event.id, event.exception or "done")
