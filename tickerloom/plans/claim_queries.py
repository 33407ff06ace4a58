"""Registered queries over claims of several workers, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import claims
from tickerloom.sources.views import table

LEASE = 120 * 86400
#: The day at which a first snapshot ends, seconds since the epoch.
CUT = 820454400


def _log(spark, sf):
    """Orders as attempts of three workers on their customers: claims, beats, failures, skips and rare successes."""
    k = F.col("o_orderkey")
    kind = F.floor(k / 4) % 12
    action = F.when(kind < 6, "claim").when(kind < 8, "beat").when(kind == 8, "failed").when(kind == 9, "skipped_data_insufficient").when((kind == 10) & (k % 7 == 0), "succeeded").otherwise("claim")
    return table(spark, sf, "orders").select(
        F.lit("1998-06-15").cast("date").alias("trade_date"),
        F.lpad((F.col("o_custkey") % 97).cast("string"), 6, "0").alias("stock_code"),
        F.concat(F.lit("w"), F.floor(k / 32) % 3).alias("worker"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"),
        action.alias("action"),
    ).distinct()


def _resumed(spark, sf):
    """States of the whole log, by way of a snapshot of its first part."""
    log = _log(spark, sf)
    first = claims.snapshot(log.where(F.col("at") < CUT), LEASE)
    return claims.snapshot(log.where(F.col("at") >= CUT), LEASE, before=first)


QUERIES = {
    "claim_states": _resumed,
    "claim_verdicts": lambda spark, sf: claims.verdicts(_log(spark, sf), LEASE),
}

_REPLAY = f"""WITH RECURSIVE log AS (SELECT DISTINCT lpad((o_custkey % 97)::VARCHAR, 6, '0') AS stock_code, 'w' || ((o_orderkey // 32) % 3) AS worker, epoch(o_orderdate)::BIGINT AS "at",
  CASE WHEN kind < 6 THEN 'claim' WHEN kind < 8 THEN 'beat' WHEN kind = 8 THEN 'failed' WHEN kind = 9 THEN 'skipped_data_insufficient' WHEN kind = 10 AND
  o_orderkey % 7 = 0 THEN 'succeeded' ELSE 'claim' END AS action
  FROM (SELECT *, (o_orderkey // 4) % 12 AS kind FROM orders)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY "at", worker, action) AS i FROM log),
replay AS (
  SELECT DISTINCT stock_code, 0::BIGINT AS i, NULL::VARCHAR AS worker, NULL::BIGINT AS "at", NULL::VARCHAR AS action, NULL::VARCHAR AS verdict, NULL::VARCHAR AS owner, NULL::VARCHAR AS status,
    NULL::BIGINT AS lease_end, 0::BIGINT AS granted, 0::BIGINT AS refused, 0::BIGINT AS ignored FROM log
  UNION ALL
  SELECT stock_code, i, worker, "at", action, verdict, CASE WHEN won THEN worker ELSE owner END, CASE WHEN won THEN 'running' WHEN verdict IN ('succeeded',
  'failed', 'skipped_data_insufficient') THEN verdict ELSE status END,
    CASE WHEN won OR verdict = 'beat' THEN "at" + {LEASE} ELSE lease_end END, granted + won::BIGINT, refused + (verdict IN ('already_succeeded', 'running_by_other'))::BIGINT,
  ignored + (verdict = 'ignored')::BIGINT
  FROM (SELECT *, verdict IN ('insert', 'retry', 'take_over') AS won FROM (
    SELECT n.*, r.owner, r.status, r.lease_end, r.granted, r.refused, r.ignored, CASE
      WHEN n.action = 'claim' THEN CASE WHEN r.status IS NULL THEN 'insert' WHEN r.status IN ('failed', 'skipped_data_insufficient') THEN 'retry'
        WHEN r.status = 'running' AND n."at" >= r.lease_end THEN 'take_over' WHEN r.status = 'succeeded' THEN 'already_succeeded' ELSE 'running_by_other' END
      WHEN r.status = 'running' AND r.owner = n.worker AND (n.action <> 'beat' OR n."at" < r.lease_end) THEN n.action ELSE 'ignored' END AS verdict
    FROM replay r JOIN numbered n ON n.stock_code = r.stock_code AND n.i = r.i + 1)))"""

ORACLES = {
    "claim_states": f"""{_REPLAY} SELECT DATE '1998-06-15' AS trade_date, stock_code, owner, status, lease_end, granted, refused, ignored
FROM replay QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY i DESC) = 1""",
    "claim_verdicts": f"""{_REPLAY} SELECT DATE '1998-06-15' AS trade_date, stock_code, worker, "at", action, verdict FROM replay WHERE i > 0""",
}
