"""Registered queries over landed payloads and digests, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import landing as L
from tickerloom.functions.newstext import fmt_num
from tickerloom.operators import sectors as S
from tickerloom.plans.sector_queries import NOW, PREF_NOW
from tickerloom.sources.views import ASOF, NEWS, news, table


def _bracketed(spark, sf):
    rows = news(spark, sf).select("event_id", "title", F.concat(F.when(F.col("score") > -30, F.lit("【lead】 ")).otherwise(""), F.col("title")).alias("content"))
    title, content = L.split_title(F.when(F.col("event_id").cast("int") % 2 == 0, F.col("title")), F.col("content"))
    return rows.select("event_id", title.alias("title"), content.alias("content"))


def _met(spark, sf):
    """News in order of arrival, many sharing an id, some without content or time."""
    n = F.col("event_id").cast("long")
    rows = news(spark, sf).withColumns({"met": n, "content": F.when(n % 10 == 3, "").otherwise(F.col("content")), "publish_ts": F.when(n % 10 != 4, F.col("publish_ts"))})
    return rows.withColumn("event_id", F.concat("title", F.lit("-"), (F.col("met") % 97).cast("string")))


def _scripted():
    """Documents' texts with script lines of two kinds and blanks of three."""
    tail = F.concat(F.lit("\n\u00a0 tail \t x \nvar a = window.location.href;\nif (document.domain) {}\ntail x\nn"), (F.col("doc_id") % 3).cast("string"))
    return F.concat(F.coalesce("text", F.lit("")), tail)


def _digest(spark, sf):
    top = S.ranking_payload(S.investment_preference(news(spark, sf), ASOF), 5)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "sector", F.lit(" | score="), fmt_num(F.col("final_score")), F.lit(" | news="), F.col("news_count").cast("string"))
    lines = top.select("rank", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))  # five rows
    return lines.select(F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).otherwise(F.lit("无可用数据")).alias("digest"))


QUERIES = {
    "split_title": _bracketed,
    "normalize_epoch": lambda spark, sf: news(spark, sf).select("event_id", L.epoch_seconds(F.when(F.col("score") > 0, F.col("publish_ts") * 1000 + 7).otherwise(F.col("publish_ts"))).alias("ts"), L.clock_text(F.col("publish_ts")).alias("clock")),
    "synth_event_id": lambda spark, sf: news(spark, sf).select("event_id", L.event_id(F.when(F.col("score") > 0, F.col("event_id")), F.col("publish_ts"), F.col("title"), F.col("source")).alias("made_id")),
    "hhmm_to_ts": lambda spark, sf: news(spark, sf).select("event_id", L.clock_to_epoch(F.substring(L.clock_text(F.col("publish_ts")), 1, 5), ASOF).alias("ts")),
    "market_prefix": lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", F.coalesce(L.market_prefix(F.lpad(F.col("o_custkey").cast("string"), 6, "9")), F.lit(-1)).alias("market")),
    "codes_in_text": lambda spark, sf: table(spark, sf, "pages").select("page_id", F.array_join(L.codes_in_text(F.concat("html", F.lit(" 600519 000001 600519 "), F.lpad(F.col("page_id").cast("string"), 6, "3"))), ",").alias("codes")),
    "snapshot_display": lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", L.hundred_millions(F.col("o_orderkey") * 123456.0).alias("shown"), L.hundred_million_shares(F.col("o_totalprice") * 1000).alias("shares")),
    "fallback_trade_date": lambda spark, sf: news(spark, sf).select("event_id", L.fallback_trade_date(F.col("publish_ts")).alias("trade_date")),
    "land_batch_clean": lambda spark, sf: L.batch_clean(_met(spark, sf), "met", 300).select("event_id", "publish_ts", "met"),
    "clean_unique_lines": lambda spark, sf: table(spark, sf, "documents").select("doc_id", L.unique_lines(_scripted()).alias("lines")).select("doc_id", F.md5(F.array_join("lines", "\n")).alias("lines_md5"), F.size("lines").alias("n_lines")),
    "ranking_digest": _digest,
}

_LOCAL = "(to_timestamp(publish_ts) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR)"
ORACLES = {
    "split_title": f"WITH {NEWS} SELECT event_id, CASE WHEN event_id::INT % 2 = 0 THEN title WHEN score > -30 THEN 'lead' ELSE '' END AS title, title AS content FROM news",
    "normalize_epoch": f"WITH {NEWS} SELECT event_id, publish_ts AS ts, strftime({_LOCAL}, '%H:%M:%S') AS clock FROM news",
    "synth_event_id": f"WITH {NEWS} SELECT event_id, CASE WHEN score > 0 THEN event_id ELSE md5(publish_ts || '+' || title || '+' || source) END AS made_id FROM news",
    "hhmm_to_ts": f"""WITH {NEWS}, c AS (SELECT event_id, {ASOF - (ASOF + 28800) % 86400} + extract(hour FROM {_LOCAL}) * 3600 + extract(minute FROM {_LOCAL}) * 60 AS t FROM
  news) SELECT event_id, (CASE WHEN t > {ASOF + 300} THEN t - 86400 ELSE t END)::BIGINT AS ts FROM c""",
    "market_prefix": """SELECT o_orderkey, CASE WHEN substr(lpad(o_custkey::VARCHAR, 6, '9'), 1, 1) IN ('5', '6', '9') THEN 1 WHEN substr(lpad(o_custkey::VARCHAR, 6, '9'), 1,
  1) IN ('0', '1', '2', '3', '4', '8') THEN 0 ELSE -1 END AS market FROM orders""",
    "codes_in_text": r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html || ' 600519 000001 600519 ' || lpad(page_id::VARCHAR, 6, '3'), '\b[0-9]{6}\b')) AS code, generate_subscripts(regexp_extract_all(html
  || ' 600519 000001 600519 ' || lpad(page_id::VARCHAR, 6, '3'), '\b[0-9]{6}\b'), 1) AS i FROM pages),
g AS (SELECT page_id, code, min(i) AS i FROM c GROUP BY page_id, code), f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM g
  QUALIFY k <= 100) SELECT page_id, string_agg(code, ',' ORDER BY i) AS codes FROM f GROUP BY page_id""",
    "snapshot_display": """SELECT o_orderkey, printf('%.2f', o_orderkey * 123456.0::DOUBLE / 1e8::DOUBLE) || '亿' AS shown, printf('%.2f', o_totalprice * 1000 / 1e8::DOUBLE) || '亿股'
  AS shares FROM orders""",
    "fallback_trade_date": f"""WITH {NEWS}, d AS (SELECT event_id, {_LOCAL}::DATE AS day, extract(hour FROM {_LOCAL}) < 9 AS early FROM news)
SELECT event_id, (day - CASE WHEN isodow(day) = 6 THEN 1 WHEN isodow(day) = 7 THEN 2 WHEN early AND isodow(day) = 1 THEN 3 WHEN early THEN 1 ELSE 0 END::INT)::DATE AS trade_date FROM d""",
    "land_batch_clean": f"""WITH {NEWS}, m AS (SELECT event_id::BIGINT AS met, title || '-' || (event_id::BIGINT % 97) AS event_id, publish_ts FROM news WHERE event_id::BIGINT % 10
  NOT IN (3, 4) AND content <> '')
SELECT * FROM (SELECT event_id, publish_ts, met FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY met) = 1) ORDER BY publish_ts DESC, met LIMIT 300""",
    "clean_unique_lines": """WITH x AS (SELECT doc_id, replace(coalesce(text, '') || chr(10) || chr(160) || ' tail ' || chr(9) || ' x ' || chr(10) || 'var a = window.location.href;'
  || chr(10) || 'if (document.domain) {}' || chr(10) || 'tail x' || chr(10) || 'n' || (doc_id % 3), chr(160), ' ') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM x),
u AS (SELECT doc_id, trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' ') AS line, min(i) AS i FROM l WHERE NOT contains(line, 'window.location.href')
  AND NOT contains(line, 'document.domain') GROUP BY 1, 2 HAVING trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' ') <> ''),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS lines, count(*) AS n FROM u GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(g.lines, '')) AS lines_md5, coalesce(g.n, 0)::INT AS n_lines FROM documents d LEFT JOIN g USING (doc_id)""",
    "ranking_digest": f"""WITH {NEWS}, {NOW}, {PREF_NOW} SELECT string_agg(rank || '. ' || sector || ' | score=' || regexp_replace(regexp_replace(printf('%.3f', round(final_score, 2)), '0+$', ''), '\\.$', '') || ' | news=' || news_count, chr(10) ORDER BY rank) AS digest FROM pref WHERE rank <= 5""",
}
