"""Registered queries of the sector views, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import panes as P
from tickerloom.operators import sectors as S
from tickerloom.sources.views import ASOF, NEWS, news
from tickerloom.streaming.ingest import rebuilt_views

AT = ASOF

_AGED = f"""aged0 AS (SELECT event_id, publish_ts, greatest(-100::DOUBLE, least(100::DOUBLE, coalesce(score, 0)::DOUBLE)) AS score, list_distinct(sectors) AS sectors,
  {{at}} AS now_ts{{more}} FROM {{source}}
  WHERE publish_ts BETWEEN {{at}} - {S.WINDOW_S} AND {{at}} AND len(coalesce(sectors, [])) > 0),
aged1 AS (SELECT *, greatest((now_ts - publish_ts) / 3600::DOUBLE, 0::DOUBLE) AS age_h, abs(score) / 100::DOUBLE AS s FROM aged0),
aged AS (SELECT *, CASE WHEN score = 0 THEN 0::DOUBLE ELSE sign(score) * 100::DOUBLE * pow(s, 2.6::DOUBLE - 1.6::DOUBLE * s) END AS strength,
  CASE WHEN age_h <= 18 THEN 1::DOUBLE ELSE exp(-{S.LN2}::DOUBLE * (age_h - 18::DOUBLE) / (18::DOUBLE + 18::DOUBLE * pow(s, 1.5::DOUBLE))) END AS decay,
  CASE WHEN age_h <= 18 THEN 1::DOUBLE ELSE exp(-{S.LN2}::DOUBLE * (age_h - 18::DOUBLE) / 18::DOUBLE) END AS heat_decay FROM aged1),
per AS (SELECT *, strength * decay AS effect, unnest(sectors) AS sector FROM aged)"""
NOW = _AGED.format(at=ASOF, more="", source="news")

PREFERENCE = """pref0 AS (SELECT {by}, count(*) AS news_count, count(*) FILTER (score > 0) AS positive_count, count(*) FILTER (score < 0) AS negative_count,
  count(*) FILTER (score = 0) AS neutral_count, sum(decay) AS e, sum(effect) AS effects, coalesce(sum(decay) FILTER (score >= 20), 0) AS p,
  coalesce(sum(decay) FILTER (score <= -20), 0) AS n, coalesce(max(abs(strength) / 100 * decay) FILTER (score > 0), 0) AS up,
  coalesce(max(abs(strength) / 100 * decay) FILTER (score < 0), 0) AS down, max(publish_ts) AS latest_ts,
  max(score) FILTER (score > 0) AS top_positive, min(score) FILTER (score < 0) AS top_negative FROM per GROUP BY {by}),
pref1 AS (SELECT * EXCLUDE (e, effects, p, n, up, down), 100 * tanh(effects / sqrt(greatest(e, 1)) / 60) AS event_score,
  100 * tanh((ln(1 + p) - ln(1 + n)) / 1.6::DOUBLE) AS count_score, 100 * (up - down) AS time_score FROM pref0),
pref2 AS (SELECT *, greatest(-100::DOUBLE, least(100::DOUBLE, 0.75::DOUBLE * event_score + 0.08::DOUBLE * count_score + 0.17::DOUBLE * time_score)) AS final_score FROM pref1),
pref AS (SELECT *, row_number() OVER ({apart} ORDER BY round(final_score, 2) DESC, round(event_score, 2) DESC, round(count_score, 2) DESC, round(time_score,
  2) DESC, news_count DESC, sector)::INT AS rank FROM pref2)"""
PREF_NOW = PREFERENCE.format(by="sector", apart="")

HEAT = """heat0 AS (SELECT {by}, count(*) AS news_count, sum(heat_decay) AS effective_news_count, count(*) FILTER (age_h <= 18) AS recent_count, max(publish_ts) AS latest_ts FROM per GROUP BY {by}),
heat1 AS (SELECT *, 100 * tanh(effective_news_count / 6) AS count_score, 100 * effective_news_count / greatest(news_count, 1) AS time_score FROM heat0),
heat2 AS (SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, 0.75::DOUBLE * count_score + 0.25::DOUBLE * time_score)) AS final_score FROM heat1),
heat AS (SELECT *, row_number() OVER ({apart} ORDER BY round(final_score, 2) DESC, round(count_score, 2) DESC, round(time_score, 2) DESC, round(effective_news_count,
  4) DESC, news_count DESC, sector)::INT AS rank FROM heat2)"""
HEAT_NOW = HEAT.format(by="sector", apart="")

FIRST, LAST = "2024-01-04", "2024-01-31"
_DAYS = f"""dated AS (SELECT news.*, d::DATE AS biz_date, epoch(d)::BIGINT AS day_ts FROM news JOIN range(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}' + INTERVAL 1 DAY, INTERVAL 1 DAY) AS k(d)
  ON publish_ts BETWEEN epoch(d) - {S.WINDOW_S} AND epoch(d)),
{_AGED.format(at="day_ts", more=", biz_date", source="dated")},
{PREFERENCE.format(by="biz_date, sector", apart="PARTITION BY biz_date")}"""


def _days(spark, sf):
    return S.ranking_days(news(spark, sf), FIRST, LAST)


#: Full hours since the epoch, of January 2024 and of the three days after it.
HOURS = (1704067200 // 3600, 1706918400 // 3600)


def _states(spark, sf):
    return P.states(P.panes(news(spark, sf)), *HOURS)


def _four_digits(ranking):
    """Without ranks, which rest on more digits than two orders of summing share."""
    return ranking.drop("rank").withColumns({c: F.round(c, 4) for c, kind in ranking.dtypes if kind == "double"})


def _hourly(spark, sf):
    """The month's rows in three parts whose panes are merged, as a stream's batches are."""
    rows = news(spark, sf)
    part = F.col("event_id").cast("long") % 3
    return P.hourly_views(P.merged_panes(*[P.panes(rows.where(part == i)) for i in range(3)]), *HOURS)


QUERIES = {
    "hourly_preference": lambda spark, sf: _four_digits(P.hourly_preference(_states(spark, sf))),
    "hourly_heat": lambda spark, sf: _four_digits(P.hourly_heat(_states(spark, sf))),
    "hourly_views": _hourly,
    "sector_3d_summary": lambda spark, sf: S.sector_summary(news(spark, sf), AT),
    "sector_3d_header": lambda spark, sf: S.sector_summary(news(spark, sf), AT).agg(F.count(F.lit(1)).alias("sector_count"), F.sum("news_count").alias("total_news_count"), F.sum("score_sum").alias("total_score_sum")),
    "investment_preference": lambda spark, sf: S.investment_preference(news(spark, sf), AT),
    "preference_header": lambda spark, sf: S.aged_news(news(spark, sf), AT).agg(F.count(F.lit(1)).alias("total_news_count"), F.lit(ASOF - S.WINDOW_S).cast("long").alias("window_start_ts"), F.lit(ASOF).cast("long").alias("window_end_ts")),
    "market_heat": lambda spark, sf: S.market_heat(news(spark, sf), AT),
    "rank_limit": lambda spark, sf: S.market_heat(news(spark, sf), AT, limit=8),
    "preference_dominant_events": lambda spark, sf: S.dominant_events(S.aged_news(news(spark, sf), AT), "preference", ["sector"]).select("sector", F.array_join("dominant_events", ",").alias("event_ids")),
    "heat_dominant_events": lambda spark, sf: S.dominant_events(S.aged_news(news(spark, sf), AT), "heat", ["sector"]).select("sector", F.array_join("dominant_events", ",").alias("event_ids")),
    "event_window": lambda spark, sf: S.event_window(news(spark, sf), AT).select("event_id", "publish_ts", "source", "score"),
    "ranking_payload": lambda spark, sf: S.ranking_payload(S.investment_preference(news(spark, sf), AT)),
    "ranking_days": lambda spark, sf: _days(spark, sf).select("biz_date", "sector", "rank", "news_count", "final_score"),
    "ranking_asof": lambda spark, sf: S.ranking_asof(_days(spark, sf), "2026-12-31").select("biz_date", "sector", "rank", "final_score"),
    "rebuilt_views": lambda spark, sf: rebuilt_views(news(spark, sf), AT),
    "ranking_history": lambda spark, sf: S.ranking_history(_days(spark, sf), "2024-01-29"),
}

_AT_HOURS = f"""at_hours AS (SELECT news.*, hour, hour * 3600 AS now FROM news JOIN range({HOURS[0]}, {HOURS[1] + 1}) AS k(hour)
  ON publish_ts BETWEEN hour * 3600 - {S.WINDOW_S} AND hour * 3600),
{_AGED.format(at="now", more=", hour", source="at_hours")}"""
_PREF_HOURS = PREFERENCE.format(by="hour, sector", apart="PARTITION BY hour")
_HEAT_HOURS = HEAT.format(by="hour, sector", apart="PARTITION BY hour")

ORACLES = {
    "hourly_preference": f"WITH {NEWS}, {_AT_HOURS}, {_PREF_HOURS} SELECT hour, sector, news_count, positive_count, negative_count, neutral_count, latest_ts, top_positive, top_negative, "
    "round(event_score, 4) AS event_score, round(count_score, 4) AS count_score, round(time_score, 4) AS time_score, round(final_score, 4) AS final_score FROM pref",
    "hourly_heat": f"WITH {NEWS}, {_AT_HOURS}, {_HEAT_HOURS} SELECT hour, sector, news_count, recent_count, latest_ts, round(effective_news_count, 4) AS effective_news_count, "
    "round(count_score, 4) AS count_score, round(time_score, 4) AS time_score, round(final_score, 4) AS final_score FROM heat",
    "hourly_views": f"""WITH {NEWS}, {_AT_HOURS}, {_PREF_HOURS}, {_HEAT_HOURS}
SELECT hour, 'summary' AS view, trim(sector) AS sector, NULL::INT AS rank, count(*) AS news_count, sum(coalesce(score, 0))::DOUBLE AS score
  FROM (SELECT hour, score, unnest(list_distinct(sectors)) AS sector FROM at_hours) GROUP BY ALL
UNION ALL SELECT hour, 'preference', sector, rank, news_count, round(final_score, 2) FROM pref
UNION ALL SELECT hour, 'heat', sector, rank, news_count, round(final_score, 2) FROM heat""",
    "sector_3d_summary": f"""WITH {NEWS} SELECT trim(sector) AS sector, count(*) AS news_count, sum(coalesce(score, 0))::BIGINT AS score_sum FROM (SELECT score, unnest(list_distinct(sectors))
  AS sector FROM news WHERE publish_ts BETWEEN {ASOF - S.WINDOW_S} AND {ASOF}) WHERE trim(sector) <> '' GROUP BY 1""",
    "sector_3d_header": f"""WITH {NEWS} SELECT count(DISTINCT sector) AS sector_count, count(*) AS total_news_count, sum(coalesce(score, 0))::BIGINT AS total_score_sum FROM (SELECT
  score, unnest(list_distinct(sectors)) AS sector FROM news WHERE publish_ts BETWEEN {ASOF - S.WINDOW_S} AND {ASOF})""",
    "investment_preference": f"WITH {NEWS}, {NOW}, {PREF_NOW} SELECT * FROM pref",
    "preference_header": f"WITH {NEWS}, {NOW} SELECT count(*) AS total_news_count, {ASOF - S.WINDOW_S}::BIGINT AS window_start_ts, {ASOF}::BIGINT AS window_end_ts FROM aged",
    "market_heat": f"WITH {NEWS}, {NOW}, {HEAT_NOW} SELECT * FROM heat",
    "rank_limit": f"WITH {NEWS}, {NOW}, {HEAT_NOW} SELECT * FROM heat WHERE rank <= 8",
    "preference_dominant_events": f"""WITH {NEWS}, {NOW} SELECT sector, string_agg(event_id, ',' ORDER BY k) AS event_ids FROM (SELECT sector, event_id, row_number() OVER (PARTITION BY sector
  ORDER BY abs(effect) DESC, publish_ts DESC, event_id) AS k FROM per) WHERE k <= 5 GROUP BY sector""",
    "heat_dominant_events": f"""WITH {NEWS}, {NOW} SELECT sector, string_agg(event_id, ',' ORDER BY k) AS event_ids FROM (SELECT sector, event_id, row_number() OVER (PARTITION BY sector
  ORDER BY age_h, publish_ts DESC, event_id) AS k FROM per) WHERE k <= 5 GROUP BY sector""",
    "event_window": f"WITH {NEWS} SELECT event_id, publish_ts, source, score FROM news WHERE publish_ts BETWEEN {ASOF - S.WINDOW_S} AND {ASOF}",
    "ranking_payload": f"WITH {NEWS}, {NOW}, {PREF_NOW} SELECT sector, rank, round(final_score, 2) AS final_score, news_count FROM pref WHERE rank <= 12",
    "rebuilt_views": f"""WITH {NEWS}, {NOW}, {PREF_NOW}, {HEAT_NOW} SELECT 'summary' AS view, trim(sector) AS sector, NULL::INT AS rank, count(*) AS news_count, sum(coalesce(score,
  0))::DOUBLE AS score FROM (SELECT score, unnest(list_distinct(sectors)) AS sector FROM news WHERE publish_ts BETWEEN {ASOF - S.WINDOW_S} AND {ASOF})
  GROUP BY ALL
UNION ALL SELECT 'preference', sector, rank, news_count, round(final_score, 2) FROM pref UNION ALL SELECT 'heat', sector, rank, news_count, round(final_score, 2) FROM heat""",
    "ranking_days": f"WITH {NEWS}, {_DAYS} SELECT biz_date, sector, rank, news_count, final_score FROM pref",
    "ranking_asof": f"WITH {NEWS}, {_DAYS} SELECT biz_date, sector, rank, final_score FROM pref WHERE biz_date = DATE '{LAST}'",
    "ranking_history": f"""WITH {NEWS}, {_DAYS} SELECT p.sector, t.rank AS top_rank, p.biz_date, p.rank, p.final_score, p.news_count FROM pref p JOIN pref t ON t.sector = p.sector
  AND t.biz_date = DATE '2024-01-29' AND t.rank <= 5 WHERE p.biz_date BETWEEN DATE '2024-01-23' AND DATE '2024-01-29'""",
}
