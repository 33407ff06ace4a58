"""Registered queries over stored versions and rejected rows, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickerloom.operators import search
from tickerloom.operators.gram_index import GramIndex
from tickerloom.operators.rejects import answer_rules, bar_rules, routed, symbol_rules
from tickerloom.operators.store import BARS_TABLE, DOCS_TABLE, NEWS_TABLE, merge_bars
from tickerloom.sources.scratch import shared_folder
from tickerloom.sources.versioned import VersionedTable
from tickerloom.sources.views import ASOF, BARS, FLAWED, NEWS, bars_flawed, news, table

CUT = ASOF - 15 * 86400
#: Bars of before, and those that a backfill brings again.
BARS_FROM, BARS_TO = "1997-01-01", "1997-07-01"


def new_table(spark, kind: dict) -> VersionedTable:
    """An empty table in the shared folder."""
    return VersionedTable(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}", **kind)


def stored_news(spark, sf) -> VersionedTable:
    """News until the middle of the month; then rows from three days before it on, changed, sent twice or moved by a day."""
    rows = news(spark, sf).select("event_id", "publish_ts", "source", "title", "score")
    new = rows.where(F.col("publish_ts") >= CUT - 3 * 86400).withColumns({"score": F.col("score") + 1, "title": F.concat("title", F.lit("!"))})
    stale = new.where(F.col("event_id").cast("long") % 5 == 0).withColumns({"publish_ts": F.col("publish_ts") - 10, "title": F.lit("stale")})
    moved = F.when(F.col("event_id").cast("long") % 11 == 0, F.col("publish_ts") + 86400).otherwise(F.col("publish_ts"))
    out = new_table(spark, NEWS_TABLE)
    out.merge(rows.where(F.col("publish_ts") < CUT), batch=("news", 0))
    again = new.unionByName(stale).withColumn("publish_ts", moved)
    out.merge(again, by="publish_ts", batch=("news", 1))
    out.merge(again.withColumn("title", F.lit("replayed")), by="publish_ts", batch=("news", 1))
    return out


def stored_bars(spark, sf) -> tuple[VersionedTable, list]:
    """Flawed bars until a day, and those from half a year before it on, sent again at another price."""
    rows = bars_flawed(spark, sf).withColumn("created_at", F.lit("first"))
    out = new_table(spark, BARS_TABLE)
    first = merge_bars(out, rows.where(F.col("trade_date") < BARS_TO))
    then = rows.where(F.col("trade_date") >= BARS_FROM).withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})
    second = merge_bars(out, then.withColumn("created_at", F.lit("second")))
    return out, [first, second]


def _docs(spark, sf) -> VersionedTable:
    rows = news(spark, sf).groupBy(search.local_date(F.col("publish_ts")).alias("biz_date")).agg(F.count(F.lit(1)).alias("n"))
    out = new_table(spark, DOCS_TABLE)
    out.merge(rows.where("biz_date < '2024-01-20'").select("biz_date", "n", F.lit("first").alias("created_at"), F.lit("first").alias("updated_at")))
    out.merge(rows.where("biz_date > '2024-01-10'").select("biz_date", (F.col("n") * 2).alias("n"), F.lit("second").alias("created_at"), F.lit("second").alias("updated_at")))
    return out


#: Twenty keywords and patterns: common and rare ones, ones that are nowhere, and four that guarantee no trigram.
KEYWORDS = (
    "purchase", "CLICK", "signup", "the thing", "Étion", "ieraux", "keit", "erstellen", "ation", "lorem", "zzzz", "a{3}bcd", "pur.hase",
    "sig+nup", r"\{\"k\": 77", "colou?rs", "k", "click|signup", "(view)", "[ét]ion",
)


def _indexed_search(spark, sf):
    """How many stored news every keyword finds, by the index; half of them are stored and indexed before the others."""
    rows = news(spark, sf).select("event_id", "publish_ts", "source", "title", "content", "score")
    stored = new_table(spark, NEWS_TABLE)
    index = GramIndex(stored, stored.path + "-grams")
    stored.merge(rows.where(F.col("publish_ts") < CUT))
    index.refresh()
    stored.merge(rows.where(F.col("publish_ts") >= CUT))
    found = index.search_many(list(KEYWORDS)).groupBy(F.col("pattern").alias("keyword"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.sum("score").alias("score_sum"))


def _before_and_after(spark, sf):
    """Per day, how many rows the two newest versions of the stored news have."""
    stored = stored_news(spark, sf)
    count = lambda v: stored.read(v).groupBy(search.local_date(F.col("publish_ts")).alias("biz_date")).agg(F.count(F.lit(1)).alias(f"rows_{v}"))
    return count(0).join(count(1), "biz_date", "full_outer")


def _answers(spark, sf):
    n = F.col("event_id")
    told = F.concat(F.lit("told: "), "props", F.lit(" end"))
    return table(spark, sf, "events").select("event_id", F.when(n % 7 == 0, F.lit("nothing")).when(n % 7 == 1, F.concat(told, F.lit(" } left"))).when(n % 7 == 2, F.concat(F.lit("{"), told)).otherwise(told).alias("answer"))


def _symbols(spark, sf):
    """A symbol per part: of too few digits, of no market, none, and, on every other part, one that begins with 0."""
    k = F.col("p_partkey")
    known = F.concat(F.lit("0"), F.lpad((k % 100_000).cast("string"), 5, "0"))
    return table(spark, sf, "part").select("p_partkey", F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat(F.lit("7"), F.lpad(k.cast("string"), 5, "0"))).when(k % 6 == 2, F.lit(None)).otherwise(known).alias("symbol"))


def _rejects(spark, sf):
    """What every operator with rules rejects, by reason, of flawed bars, odd symbols and broken answers."""
    parts = (
        routed(bars_flawed(spark, sf), "upsert_bars", bar_rules(), ["symbol", "trade_date"]),
        routed(_symbols(spark, sf), "market_prefix", symbol_rules(), ["p_partkey"]),
        routed(_answers(spark, sf), "extract_json", answer_rules(), ["event_id"]),
    )
    out = parts[0].rejected.unionByName(parts[1].rejected).unionByName(parts[2].rejected)
    return out.groupBy("operator", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


QUERIES = {
    "stored_news": lambda spark, sf: stored_news(spark, sf).read(),
    "stored_bars": lambda spark, sf: stored_bars(spark, sf)[0].read(),
    "stored_daily_docs": lambda spark, sf: _docs(spark, sf).read(),
    "stored_versions": _before_and_after,
    "stored_bars_history": lambda spark, sf: stored_bars(spark, sf)[0].history(),
    "rejects": _rejects,
    "indexed_search": _indexed_search,
}

_MERGED = f"""merged AS (SELECT event_id, CASE WHEN publish_ts >= {CUT} - 3 * 86400 AND event_id::BIGINT % 11 = 0 THEN publish_ts + 86400 ELSE publish_ts END AS publish_ts, source,
  CASE WHEN publish_ts >= {CUT} - 3 * 86400 THEN title || '!' ELSE title END AS title, (CASE WHEN publish_ts >= {CUT} - 3 * 86400 THEN score + 1 ELSE score END)::INT AS score FROM news)"""
_DATE = "((to_timestamp(publish_ts) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR)::DATE)"
_FAULT = """CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'price missing' WHEN high < greatest(open, close, low) THEN 'high below another price'
  WHEN low > least(open, close, high) THEN 'low above another price' END"""
_GOOD = f"good AS (SELECT * FROM bars_flawed WHERE ({_FAULT}) IS NULL)"

ORACLES = {
    "stored_news": f"WITH {NEWS}, {_MERGED} SELECT * FROM merged",
    "stored_bars": f"""WITH {BARS}, {FLAWED}, {_GOOD} SELECT symbol, trade_date, open + up AS open, high + up AS high, low + up AS low, close + up AS close,
  CASE WHEN trade_date < DATE '{BARS_TO}' THEN 'first' ELSE 'second' END AS created_at FROM (SELECT *, CASE WHEN trade_date >= DATE '{BARS_FROM}' THEN 1 ELSE 0 END AS up FROM good)""",
    "stored_daily_docs": f"""WITH {NEWS}, d AS (SELECT {_DATE} AS biz_date, count(*) AS n FROM news GROUP BY 1)
SELECT biz_date, CASE WHEN biz_date > DATE '2024-01-10' THEN n * 2 ELSE n END AS n, CASE WHEN biz_date < DATE '2024-01-20' THEN 'first' ELSE 'second' END AS created_at,
  CASE WHEN biz_date > DATE '2024-01-10' THEN 'second' ELSE 'first' END AS updated_at FROM d""",
    "stored_versions": f"""WITH {NEWS}, {_MERGED}, a AS (SELECT {_DATE} AS biz_date, count(*) AS rows_0 FROM news WHERE publish_ts < {CUT} GROUP BY 1),
b AS (SELECT {_DATE} AS biz_date, count(*) AS rows_1 FROM merged GROUP BY 1) SELECT biz_date, rows_0, rows_1 FROM a FULL JOIN b USING (biz_date)""",
    "stored_bars_history": f"""WITH {BARS}, {FLAWED}, {_GOOD}, of AS (SELECT trade_date, count(*) AS n FROM good GROUP BY 1)
SELECT 0 AS version, count(*)::INT AS partitions, sum(n)::BIGINT AS rows, count(*)::INT AS rewritten FROM of WHERE trade_date < DATE '{BARS_TO}'
UNION ALL SELECT 1, count(*)::INT, sum(n)::BIGINT, count(*) FILTER (trade_date >= DATE '{BARS_FROM}')::INT FROM of""",
    "indexed_search": f"""WITH {NEWS}, k(keyword) AS (VALUES {", ".join("('" + k + "')" for k in KEYWORDS)})
SELECT keyword, count(*) AS n, min(event_id) AS first_id, sum(score)::BIGINT AS score_sum FROM news JOIN k ON regexp_matches(title, '(?i)' || keyword)
  OR regexp_matches(content, '(?i)' || keyword) GROUP BY keyword""",
    "rejects": rf"""WITH {BARS}, {FLAWED}, r AS (
  SELECT 'upsert_bars' AS operator, {_FAULT} AS reason, symbol || '/' || trade_date AS key FROM bars_flawed
  UNION ALL SELECT 'market_prefix', CASE WHEN p_partkey % 6 IN (0, 2) AND (p_partkey % 6 = 2 OR length(p_partkey::VARCHAR) <> 6) THEN 'not six digits'
    WHEN p_partkey % 6 = 1 OR (p_partkey % 6 = 0 AND p_partkey::VARCHAR LIKE '7%') THEN 'no market of this digit' END, p_partkey::VARCHAR FROM part
  UNION ALL SELECT 'extract_json', CASE event_id % 7 WHEN 0 THEN 'no object' WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not JSON' END, event_id::VARCHAR FROM events)
SELECT operator, reason, count(*) AS n, min(key) AS first_key FROM r WHERE reason IS NOT NULL GROUP BY ALL""",
}
