"""Figures of every micro-batch, written by a listener while a stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tickerloom.sources.versioned import Journal, VersionConflict

#: The name under which a stream observes its landed rows.
LANDED = "landed"
SCHEMA = "batch bigint, landed bigint, sources bigint, oldest bigint, newest bigint, stored bigint, guarded_ids bigint, duration_ms bigint"


def observed(landed: DataFrame) -> DataFrame:
    return landed.observe(
        LANDED,
        F.count(F.lit(1)).alias("landed"),
        F.size(F.collect_set("source")).cast("bigint").alias("sources"),
        F.min("publish_ts").alias("oldest"),
        F.max("publish_ts").alias("newest"),
    )


class BatchFigures(StreamingQueryListener):
    """Writes one document per batch of a stream to folder: what landed and what of it was stored, the ids that the guard
    holds, and the time taken. stored is filled in by the stream's own batches."""

    def __init__(self, spark: SparkSession, folder: str, query_name: str):
        self._spark, self._journal, self._name, self._run = spark, Journal(spark, folder), query_name, None
        self.stored: dict[int, int] = {}

    def onQueryStarted(self, event) -> None:
        if event.name == self._name:
            self._run = event.runId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._run:
            self._spark.streams.removeListener(self)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self._name or LANDED not in p.observedMetrics:
            return
        seen = p.observedMetrics[LANDED].asDict()
        kept = sum(s.numRowsTotal for s in p.stateOperators)
        document = {"batch": p.batchId, **seen, "stored": self.stored.get(p.batchId, 0), "guarded_ids": kept, "duration_ms": p.durationMs.get("triggerExecution", 0)}
        try:
            self._journal._put(p.batchId, document)
        except VersionConflict:  # a replayed batch: its first figures stay
            pass


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of the batches so far, a row each; events that are on their way to listeners are waited for."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    journal = Journal(spark, folder)
    return spark.createDataFrame([journal._get(n) for n in journal.versions()], SCHEMA)
