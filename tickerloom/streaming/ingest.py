"""Landed news as a stream: per source late rows are dropped, known events skipped, stories deduplicated, scores cleaned.

One micro-batch is one pass of batch operators over new rows, so that a replay of the whole input gives the same store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.functions.newstext import norm_sector_list, score_postprocess
from tickerloom.operators.panes import HOUR_S, PANES_SCHEMA, WINDOW_H, hourly_views, merged_panes, panes
from tickerloom.operators.search import new_events_only, past_cursor
from tickerloom.operators.sectors import WINDOW_S, event_window, investment_preference, market_heat, sector_summary
from tickerloom.operators.store import newest
from tickerloom.operators.story_dedup import greedy
from tickerloom.sources.scratch import scratch_table
from tickerloom.streaming.figures import BatchFigures, observed
from tickerloom.streaming.repair import NEWS_SCHEMA, QUEUE_SCHEMA, Scorer, scored

STATE_SCHEMA = "batch bigint, source string, newest bigint"
#: How far before the oldest cursor stored ids are looked up.
HORIZON_S = 30 * 86400


def landed(spark: SparkSession, path: str, files_per_batch: int = 50, archive: str | None = None) -> DataFrame:
    """The files of a folder as a stream; those read are moved to archive, if there is one, so that listing stays short."""
    reader = spark.readStream.schema(NEWS_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.parquet(path)


def in_flight_guard(rows: DataFrame, wait_s: int) -> DataFrame:
    """Rows whose id did not arrive in the last wait_s seconds, by ids kept in the state store.

    Time is that of arrival, so no source's rows are late for being old, and ids leave the state once wait_s has passed.
    Of rows of an id in one batch any one stays.
    """
    timed = rows.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", f"{wait_s} seconds")
    return timed.dropDuplicatesWithinWatermark(["event_id"]).drop("__arrived")


def cleaned(rows: DataFrame) -> DataFrame:
    """Sectors normalised and scores post-processed; without sectors a score of null is 0."""
    sectors = norm_sector_list(F.col("sectors"), F.col("content"), F.col("subjects"))
    return rows.withColumn("sectors", sectors).withColumn("score", score_postprocess(F.col("score"), F.col("sectors"), F.col("content")))


def ingest_batch(batch: DataFrame, cursor: DataFrame, stored_ids: DataFrame, scorer: Scorer | None = None, repairer: Scorer | None = None, attempts: int = 1) -> tuple[DataFrame, DataFrame]:
    """The rows of a micro-batch that are to be stored, and the queue of repairs to their scores.

    Stored are rows not older than their source's cursor, of ids not stored yet, each id once (its earliest row), stories
    once. cursor: source and newest, a row per source; stored_ids: event_id.
    """
    once = newest(batch, ["event_id"], "publish_ts", earliest=True)
    kept = greedy(scratch_table(new_events_only(past_cursor(once, cursor), stored_ids)))
    queue = batch.sparkSession.createDataFrame([], QUEUE_SCHEMA)
    if scorer:
        kept, queue = scored(kept, scorer, repairer, attempts)
    return cleaned(kept), queue


def rebuilt_views(news: DataFrame, asof: Column | int) -> DataFrame:
    """The three sector views at asof as one table: view, sector, rank, news_count and score (the summary's sum, else the
    ranking's final score to two digits)."""
    window = event_window(news, asof)
    row = lambda view, df, score: df.select(F.lit(view).alias("view"), "sector", "rank", F.col("news_count").cast("bigint").alias("news_count"), score.cast("double").alias("score"))
    summary = sector_summary(window, asof).withColumn("rank", F.lit(None).cast("int"))
    out = row("summary", summary, F.col("score_sum"))
    for view, ranking in (("preference", investment_preference(window, asof)), ("heat", market_heat(window, asof))):
        out = out.unionByName(row(view, ranking, F.round("final_score", 2)))
    return out


def moved_views(session: SparkSession, store: str, number: int, rows: DataFrame, live: list[int], first: int, asof: int) -> None:
    """Adds a batch's panes to the store, and the views of every full hour from the second first to asof.

    Reads panes of the batches live, never rows of theirs.
    """
    panes(rows).coalesce(1).write.mode("overwrite").parquet(f"{store}/panes/batch={number}")
    parts = session.read.schema(PANES_SCHEMA).parquet(*[f"{store}/panes/batch={i}" for i in live])
    hourly_views(merged_panes(parts), -(-first // HOUR_S), asof // HOUR_S).coalesce(1).write.mode("overwrite").parquet(f"{store}/hourly/batch={number}")


def hourly(spark: SparkSession, store: str) -> DataFrame:
    """The views of every full hour as the last batch that changed it left them."""
    rows = spark.read.parquet(f"{store}/hourly")
    latest = rows.groupBy("hour").agg(F.max("batch").alias("latest"))  # a row per hour
    return rows.join(latest, "hour").where("batch = latest").drop("batch", "latest")


def start(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    scorer: Scorer | None = None,
    horizon_s: int | None = HORIZON_S,
    views: bool = False,
    hours: bool = False,
    repairer: Scorer | None = None,
    attempts: int = 1,
    guard_s: int | None = None,
    every: str | None = None,
    archive: str | None = None,
    files_per_batch: int = 50,
) -> StreamingQuery:
    """Ingests what lands at source into the Parquet store: what is there, then stops, or with every ("5 minutes") at each
    such interval until it is stopped.

    A batch writes rows/batch=n, with views views/batch=n, with hours panes/batch=n and hourly/batch=n, with a repairer
    repairs/batch=n, and state/batch=n: per source and batch that is still looked at, its newest time. It reads only the
    state before it and the batches named there, so its cost does not grow with the history. hours is for a store that has
    had it from its first batch on. Ids are looked up in batches up to horizon_s before the oldest cursor (None: in all);
    guard_s keeps ids in flight in the state store as well. A batch that is replayed overwrites its folders, so each row is
    stored once. Figures of every batch go to figures/; archive takes the files that were read.
    """
    name = f"ingest-{uuid.uuid4().hex}"
    listener = BatchFigures(spark, f"{store}/figures", name)

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = session.read.schema(STATE_SCHEMA).parquet(f"{store}/state/batch={number - 1}").collect() if number else []  # a row per source and live batch
        cursor: dict[str, int] = {}
        for r in state:
            cursor[r["source"]] = max(r["newest"], cursor.get(r["source"], r["newest"]))
        low = min(cursor.values()) - horizon_s if cursor and horizon_s is not None else None
        live = sorted({r["batch"] for r in state if low is None or r["newest"] >= low})
        empty = session.createDataFrame([], NEWS_SCHEMA)
        stored = session.read.schema(NEWS_SCHEMA).parquet(*[f"{store}/rows/batch={i}" for i in live]) if live else empty
        cursors = session.createDataFrame(list(cursor.items()), "source string, newest bigint")
        path = f"{store}/rows/batch={number}"
        fresh, queue = ingest_batch(batch, cursors, stored.select("event_id"), scorer, repairer, attempts)
        fresh.write.mode("overwrite").parquet(path)
        if repairer:
            queue.coalesce(1).write.mode("overwrite").parquet(f"{store}/repairs/batch={number}")
        rows = session.read.schema(NEWS_SCHEMA).parquet(path)
        listener.stored[number] = rows.count()
        ends = rows.groupBy("source").agg(F.max("publish_ts").alias("newest")).select(F.lit(number).cast("bigint").alias("batch"), "source", "newest").collect()  # a row per source
        now = [tuple(r) for r in [*state, *ends]]
        top = {}
        for _, name, ts in now:
            top[name] = max(ts, top.get(name, ts))
        floor = min(top.values()) - max(horizon_s, WINDOW_S) if top and horizon_s is not None else None
        kept = [r for r in now if floor is None or r[2] >= floor or r[2] == top[r[1]]]
        session.createDataFrame(kept, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{store}/state/batch={number}")
        if views and top:
            asof = max(top.values())
            recent = sorted({r[0] for r in kept if r[2] >= asof - WINDOW_S})
            seen = session.read.schema(NEWS_SCHEMA).parquet(*[f"{store}/rows/batch={i}" for i in recent])
            rebuilt_views(seen, asof).coalesce(1).write.mode("overwrite").parquet(f"{store}/views/batch={number}")
        if hours and top:
            # From the oldest of the batch's rows, or from where the views ended if that is earlier.
            oldest = rows.agg(F.min("publish_ts")).first()[0]
            first = min([x for x in (oldest, max(cursor.values()) + 1 if cursor else None) if x is not None])
            near = sorted({number, *(r[0] for r in now if r[2] >= first - (WINDOW_H + 1) * HOUR_S)})
            moved_views(session, store, number, rows, near, first, max(top.values()))

    stream = observed(landed(spark, source, files_per_batch, archive))
    if guard_s is not None:
        stream = in_flight_guard(stream, guard_s)
    spark.streams.addListener(listener)
    writer = stream.writeStream.queryName(name).foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
