"""Scoring in rounds: what a scorer got wrong waits in a queue for the next round, and answers are merged back by event.

A first answer needs repair if it names sectors of which none is known, or has known sectors and a score of zero, or a
weak one for a strong event. Rows that need repair form the queue of the next attempt; the repairer gets them with the
answer so far. Rows that still need repair after the last attempt keep its answer and stay open in the queue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.newstext import needs_repair, norm_sector_list
from tickerloom.sources.scratch import scratch_table

NEWS_SCHEMA = "event_id string, publish_ts bigint, source string, title string, content string, subjects array<string>, score int, companies array<string>, sectors array<string>"
QUEUE_SCHEMA = "event_id string, attempt int, score int, sectors array<string>, open boolean"

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def guarded(scorer: Scorer) -> Scorer:
    """scorer for rows with content; a row that it fails on, and one without content, gets a neutral score and no lists."""

    def neutral(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(score=0, companies=None, sectors=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            told = rows["content"].fillna("").str.strip() != ""
            if not told.all():
                yield neutral(rows[~told])
            try:
                yield from list(scorer(iter([rows[told]])))
            except Exception:  # whatever a scorer raises: find the rows it fails on
                for i in range(int(told.sum())):
                    one = rows[told].iloc[i : i + 1]
                    try:
                        yield from list(scorer(iter([one])))
                    except Exception:
                        yield neutral(one)

    return run


def scored(rows: DataFrame, scorer: Scorer, repairer: Scorer | None = None, attempts: int = 1) -> tuple[DataFrame, DataFrame]:
    """rows with their final answers, as the scorers gave them, and the queue: a row per event and attempt at repair.

    Every scorer sees a row once per attempt: its answers are written before they are looked at, and whether they need
    repair with them, so that it is worked out once.
    """
    spark = rows.sparkSession

    def round_of(rows: DataFrame, by: Scorer) -> DataFrame:
        told = rows.mapInPandas(guarded(by), NEWS_SCHEMA)
        known = norm_sector_list(F.col("sectors"), F.col("content"), F.col("subjects"))
        return scratch_table(told.withColumn("open", F.coalesce(needs_repair(F.col("content"), F.col("sectors"), known, F.col("score")), F.lit(False))))

    answers = round_of(rows, scorer)
    queue = spark.createDataFrame([], QUEUE_SCHEMA)
    if repairer is None:
        return answers.drop("open"), queue
    done = answers.where(~F.col("open"))
    for attempt in range(1, attempts + 1):
        answers = round_of(answers.where("open").drop("open"), repairer)
        queue = queue.unionByName(answers.select("event_id", F.lit(attempt).alias("attempt"), "score", "sectors", "open"))
        done = done.unionByName(answers if attempt == attempts else answers.where(~F.col("open")))
    return done.drop("open"), queue


def open_repairs(queue: DataFrame) -> DataFrame:
    """event_id, attempts and the last answer of the events whose last attempt failed."""
    last = queue.groupBy("event_id").agg(F.max(F.struct("attempt", "open", "score", "sectors")).alias("last"))
    return last.where("last.open").select("event_id", F.col("last.attempt").alias("attempts"), "last.score", "last.sectors")
