"""Registered queries over the rounds that streams run their batches through, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickerloom.functions.newstext import SECTORS
from tickerloom.sources.scratch import shared_folder
from tickerloom.sources.views import ASOF, NEWS, news
from tickerloom.streaming.figures import figures
from tickerloom.streaming.ingest import start
from tickerloom.streaming.repair import open_repairs, scored


def _first(batches):
    """A scorer whose answers are wrong in four ways of ten, by the event."""
    for rows in batches:
        kind = rows["event_id"].astype(int) % 10
        sectors = [None if k == 9 else ["nowhere"] if k in (0, 1) else [SECTORS[0]] for k in kind]
        yield rows.assign(score=kind.map({2: 0, 3: 0}).fillna(30).astype(int), sectors=sectors)


def _second(batches):
    """A repairer that names a known sector first, scores at the next attempt, and never learns some events."""
    for rows in batches:
        number = rows["event_id"].astype(int)
        named = [s is not None and "nowhere" not in s for s in rows["sectors"]]
        score = [0 if n % 70 in (0, 2) or not ok else 20 for n, ok in zip(number, named, strict=True)]
        yield rows.assign(score=score, sectors=[[SECTORS[1]]] * len(rows))


def _rounds(spark, sf):
    columns = ["event_id", "publish_ts", "source", "title", "props AS content", "subjects", "score", "companies", "sectors"]
    rows = news(spark, sf).withColumn("props", F.concat(F.lit("no event words in this, number "), "event_id")).selectExpr(*columns)
    return scored(rows, _first, _second, attempts=2)


#: Where the first landing ends, and how far back the second reaches.
CUT, BACK = ASOF - 10 * 86400, 2 * 86400
#: Files of a landing, fewer than a batch takes.
LANDED_FILES = 32


def _streamed(spark, sf) -> str:
    """The store of a stream over two landings of news: the second brings the first's last days again, late rows among
    them, and every seventh event twice. Run twice with a restart between, ids in flight guarded by the state store."""
    rows = news(spark, sf).withColumns({"content": F.concat(F.lit("a story that only number "), "event_id", F.lit(" tells")), "title": F.lit("")})
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    ts, twice = F.col("publish_ts"), rows.where(F.col("event_id").cast("long") % 7 == 0)
    for landing in (ts < CUT, ts >= CUT - BACK):
        # A bounded number of files, so that a landing is one batch.
        rows.where(landing).unionByName(twice.where(landing)).repartition(LANDED_FILES, "event_id").write.mode("append").parquet(f"{folder}/in")
        start(spark, f"{folder}/in", f"{folder}/store", f"{folder}/check", guard_s=3600).awaitTermination()
    return f"{folder}/store"


def _stored(spark, sf):
    return spark.read.parquet(f"{_streamed(spark, sf)}/rows").select("event_id", "publish_ts", "source", "score")


def _figures(spark, sf):
    """Of the batches with rows; there is one without, in which ids leave the guard's state."""
    return figures(spark, f"{_streamed(spark, sf)}/figures").where("landed > 0").select("landed", "sources", "oldest", "newest", "stored")


QUERIES = {
    "stream_stored": _stored,
    "stream_figures": _figures,
    "repair_queue": lambda spark, sf: _rounds(spark, sf)[1].withColumn("sectors", F.array_join("sectors", ",")),
    "repaired_scores": lambda spark, sf: _rounds(spark, sf)[0].select("event_id", "score", F.array_join("sectors", ",").alias("sectors")),
    "repairs_open": lambda spark, sf: open_repairs(_rounds(spark, sf)[1]).select("event_id", "attempts", "score"),
}

_ROUNDS = f"""first AS (SELECT event_id, event_id::BIGINT % 10 AS kind, event_id::BIGINT % 70 IN (0, 2) AS never FROM news),
queue AS (SELECT event_id, 1 AS attempt, CASE WHEN never OR kind < 2 THEN 0 ELSE 20 END AS score, '{SECTORS[1]}' AS sectors FROM first WHERE kind < 4
  UNION ALL SELECT event_id, 2, CASE WHEN never THEN 0 ELSE 20 END, '{SECTORS[1]}' FROM first WHERE kind < 2 OR (kind < 4 AND never))"""

_STREAM = f"""landed AS (SELECT 0 AS batch, * FROM news WHERE publish_ts < {CUT} UNION ALL SELECT 1, * FROM news WHERE publish_ts >= {CUT - BACK}),
stored AS (SELECT event_id, publish_ts, source, score, batch FROM landed WHERE batch = 0 OR publish_ts >= {CUT})"""

ORACLES = {
    "stream_stored": f"WITH {NEWS}, {_STREAM} SELECT event_id, publish_ts, source, score FROM stored",
    "stream_figures": f"""WITH {NEWS}, {_STREAM} SELECT (count(*) + count(*) FILTER (event_id::BIGINT % 7 = 0))::BIGINT AS landed, count(DISTINCT source)::BIGINT AS sources,
  min(publish_ts) AS oldest, max(publish_ts) AS newest, any_value(n) AS stored FROM landed JOIN (SELECT batch, count(*) AS n FROM stored GROUP BY 1) USING (batch) GROUP BY batch""",
    "repair_queue": f"WITH {NEWS}, {_ROUNDS} SELECT event_id, attempt, score, sectors, score = 0 AS open FROM queue",
    "repaired_scores": f"""WITH {NEWS}, {_ROUNDS} SELECT event_id, 30 AS score, CASE WHEN kind < 9 THEN '{SECTORS[0]}' END AS sectors FROM first WHERE kind >= 4
UNION ALL SELECT event_id, score, sectors FROM queue QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY attempt DESC) = 1""",
    "repairs_open": f"WITH {NEWS}, {_ROUNDS} SELECT event_id, attempt AS attempts, score FROM queue WHERE attempt = 2 AND score = 0",
}
