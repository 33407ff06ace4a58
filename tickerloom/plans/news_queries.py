"""Registered queries over news: search, listings, counts, text functions and dedup, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import newstext as X
from tickerloom.operators import search, story_dedup
from tickerloom.operators.deep_pages import deep_page
from tickerloom.operators.store import upsert_daily, upsert_news
from tickerloom.sources.views import ASOF, NEWS, news, table

DAY = "2024-01-29"
_DAY_START = f"(epoch(TIMESTAMP '{DAY}') - 28800)"
_LOCAL = "(to_timestamp(publish_ts) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR)"
_FOUND = f"""publish_ts >= {_DAY_START} AND publish_ts < {_DAY_START} + 86400 AND list_contains(sectors, 'click') AND regexp_matches(coalesce(title, '') || chr(10)
  || coalesce(content, ''), '(?i)k') AND score >= -45"""
_SENTIMENT = "CASE WHEN score >= 20 THEN 'positive' WHEN score <= -20 THEN 'negative' ELSE 'neutral' END"


def _searched(spark, sf):
    return search.filtered(news(spark, sf), trade_date=DAY, sector="click", keyword="k", min_score=-45)


def _split(spark, sf):
    """The first half of the rows by time as stored news, the second as incoming."""
    rows = news(spark, sf)
    half = ASOF - 15 * 86400
    return rows.where(F.col("publish_ts") < half), rows.where(F.col("publish_ts") >= half - 86400)


def _text(spark, sf):
    return news(spark, sf).select("event_id", "title", "content", "subjects", "sectors", "score")


def _nth(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _id():
    return F.col("event_id").cast("long")


def _sited(text, n):
    """Texts that begin and end with what the feeds add, in turn."""
    fronts = ("", "财联社1月12日电，", "金十数据3月4日讯:", "[金十数据]", "财联社：", "同花顺9月30日讯，", "[同花顺],", "头 金十数据1月2日讯，")
    ends = ("", " - 金十数据 ", "—财联社", " 金十数据", "财联社\n", " — 同花顺", "同花顺", "（同花顺） ", "“引”")
    return F.concat(_nth(fronts, n), F.coalesce(text, F.lit("")), _nth(ends, F.floor(n / 3)))


def _titles():
    return F.concat(_nth(("  ", "金十图示", "新闻联播今日要点", "今日要点", "金十数据", "快讯", "财联社", "五个字的题", "六个字的标题"), _id()), F.when(_id() % 2 == 0, F.lit("一二三")).otherwise("　"))


def _name():
    """Names that each of the five steps finds, or none: every sector and every alias comes up in every form."""
    sector, alias = _nth(X.SECTORS, _id()), _nth(tuple(X.ALIASES), _id())
    spread = lambda x: F.concat(F.substring(x, 1, 1), F.lit("、 "), F.substring(x, 2, 20))
    forms = (F.concat(F.lit("　"), sector), F.concat(F.lit("某"), sector, F.lit("公司")), spread(sector), spread(alias), F.concat(F.lit("近期"), alias, F.lit("板块")), F.concat(F.lit("x"), _id().cast("string")), F.lit(" "), F.lit(None).cast("string"), F.concat(F.lit("ETF-"), alias))
    k = F.floor(_id() / 90) % len(forms)
    out = F.when(k == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        out = out.when(k == i, form)
    return out


def _words():
    return [w for pattern, _ in X.CONTENT_RULES for w in pattern.strip("()").split("|")]


def _told():
    """Sentences of up to four words of the content rules, in changing order and case."""
    words = _words()
    return F.concat_ws("，", F.lit("报道"), _nth(words, _id()), F.when(_id() % 3 > 0, F.lower(_nth(words, _id() * 7 + 3))), F.when(_id() % 3 > 1, _nth(words, _id() * 11 + 5)), F.when(_id() % 5 == 0, _nth(words, _id() * 13 + 9)))


def _items():
    return F.when(_id() % 4 < 2, F.array(_name(), _nth(X.SECTORS, _id() * 3), F.lit("不明"), _name(), _nth(X.SECTORS, _id() * 5), _nth(X.SECTORS, _id() * 7)))


def _subjects():
    return F.when(_id() % 4 == 2, F.array(_nth(tuple(X.ALIASES), _id()), _name()))


def _said():
    """Sentences of words of each kind of event, with and without an office or a number."""
    k = _id()
    return F.concat_ws(" ", F.when(k % 3 != 2, _nth(X.POSITIVE, k)), F.when(k % 4 == 1, _nth(X.NEGATIVE, k)), F.when(k % 8 == 3, _nth(X.NEGATIVE, k * 3 + 1)), F.when(k % 5 == 0, _nth(X.OFFICIAL, k)), F.when(k % 7 == 0, F.lit("8%")), F.when(k % 9 == 0, _nth(X.HARD_EVENTS, k)), F.col("title"))


def _answer():
    """What a scorer may tell: plain, fenced or no JSON, scores and lists of every type."""
    k = _id() % 12
    scores = ("7", "-250", "true", '"about -12 or 3"', "2.5", "3.5", "null", "-7.6", '"x"', "99", "0", "[1]")
    lists = ('["甲 ", "乙", "甲", ""]', '"丙、丁;丙"', "null", '"null"', "[]", '" "')
    sectors = ('["芯片", "白酒"]', '"半导体，银行"', "null", '["不明"]', '"养猪"', "[]")
    reason = ('" why "', '""', "null", '"r"')
    body = F.concat(F.lit('{"score": '), _nth(scores, k), F.lit(', "reason": '), _nth(reason, _id()), F.lit(', "companies": '), _nth(lists, _id()), F.lit(', "sectors": '), _nth(sectors, F.floor(_id() / 12)), F.lit("}"))
    return F.when(_id() % 5 == 4, F.lit("no object")).when(_id() % 5 == 3, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\n{end}"))).otherwise(F.concat(F.lit("so: "), body))


def _fenced():
    n = F.col("event_id")
    return F.when(n % 3 == 0, F.concat(F.lit("first {no}\n```json\n"), "props", F.lit("\n```\nthen {not}"))).when(n % 3 == 1, F.concat(F.lit("```\n"), "props", F.lit(" ```"))).otherwise(F.concat(F.lit("told: "), "props", F.lit(" end")))


def _date_text():
    n = F.col("o_orderkey")
    return F.when(n % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(n % 4 == 1, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"))).when(n % 4 == 2, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(" ")


def _number():
    n = F.col("o_orderkey")
    return F.when(n % 5 == 0, n.cast("string")).when(n % 5 == 1, F.concat(F.lit("-"), n.cast("string"))).when(n % 5 == 2, F.lit("n/a")).when(n % 5 == 3, F.concat(n.cast("string"), F.lit(".75")))


def _noise_sql(text: str) -> str:
    out = f"trim(coalesce({text}, ''), ' ' || chr(9) || chr(10) || chr(13))"
    for pattern in X.DEDUP_NOISE:
        out = "regexp_replace({}, '{}', '', 'g')".format(out, pattern.replace("'", "''"))
    return f"lower({out})"


_KEYS = f"""k0 AS (SELECT event_id, publish_ts, source, title, content, subjects, {_noise_sql("title")} AS named, {_noise_sql("content")} AS whole,
  {_noise_sql("CASE WHEN starts_with(content, title) AND length(content) > length(title) THEN substr(content, length(title) + 1) ELSE content END")} AS rest FROM news),
keys AS (SELECT DISTINCT event_id, key FROM (SELECT event_id, unnest([CASE WHEN length(title) >= 6 THEN 'title::' || named END,
  CASE WHEN length(whole) >= 12 THEN 'content::' || whole END, CASE WHEN length(rest) >= 12 THEN 'content::' || rest END]) AS key FROM k0) WHERE key IS NOT NULL)"""

def _store(spark, sf):
    """Stored news until the middle of the month, and rows from three days before it on, changed and partly repeated."""
    rows = news(spark, sf).select("event_id", "publish_ts", "source", "title", "score")
    cut = ASOF - 15 * 86400
    new = rows.where(F.col("publish_ts") >= cut - 3 * 86400).withColumns({"score": F.col("score") + 1, "title": F.concat("title", F.lit("!"))})
    stale = new.where(F.col("event_id").cast("long") % 5 == 0).withColumns({"publish_ts": F.col("publish_ts") - 10, "title": F.lit("stale")})
    return rows.where(F.col("publish_ts") < cut), new.unionByName(stale)


def _daily(spark, sf):
    rows = news(spark, sf).groupBy(search.local_date(F.col("publish_ts")).alias("biz_date")).agg(F.count(F.lit(1)).alias("n"))
    old = rows.where("biz_date < '2024-01-20'").select("biz_date", "n", F.lit("first").alias("created_at"), F.lit("first").alias("updated_at"))
    new = rows.where("biz_date > '2024-01-10'").select("biz_date", (F.col("n") * 2).alias("n"), F.lit("second").alias("created_at"), F.lit("second").alias("updated_at"))
    return upsert_daily(old, new)


QUERIES = {
    "upsert_news": lambda spark, sf: upsert_news(*_store(spark, sf)),
    "upsert_daily_doc": _daily,
    "news_search": lambda spark, sf: search.page(_searched(spark, sf), skip=5, limit=40).select("event_id", "publish_ts", "title", "score"),
    "deep_page": lambda spark, sf: deep_page(news(spark, sf).select("event_id", "publish_ts", "title", "score"), skip=7000, limit=60, small=200),
    "news_count": lambda spark, sf: _searched(spark, sf).agg(F.count(F.lit(1)).alias("n")),
    "news_by_sector": lambda spark, sf: search.page(search.filtered(news(spark, sf), sector="U7"), limit=30).select("event_id", "publish_ts"),
    "news_by_id": lambda spark, sf: news(spark, sf, only_id=77).select("event_id", "publish_ts", "source", "title", "score"),
    "news_latest": lambda spark, sf: search.page(news(spark, sf), limit=100).select("event_id", "publish_ts", "source", "title", "content", "score", F.array_join("sectors", ",").alias("sectors"), F.array_join("companies", ",").alias("companies")),
    "news_recent": lambda spark, sf: search.recent(news(spark, sf), ASOF, 3),
    "hours_back": lambda spark, sf: search.hours_back(news(spark, sf), ASOF - 7200, 24).select("event_id", "publish_ts"),
    "score_tag": lambda spark, sf: _text(spark, sf).select("event_id", X.score_tag(F.col("score")).alias("tag"), X.sentiment(F.col("score")).alias("sentiment")),
    "top_companies": lambda spark, sf: search.top_items(news(spark, sf), "companies"),
    "top_sectors": lambda spark, sf: search.top_items(news(spark, sf), "sectors"),
    "news_totals": lambda spark, sf: search.totals(news(spark, sf), ASOF - 3600),
    "sentiment_share": lambda spark, sf: search.sentiment_share(_searched(spark, sf)),
    "latest_cursor": lambda spark, sf: search.source_cursor(news(spark, sf)),
    "new_events_only": lambda spark, sf: search.new_events_only(_split(spark, sf)[1], _split(spark, sf)[0]).select("event_id", "publish_ts"),
    "after_cursor": lambda spark, sf: search.after_cursor(_split(spark, sf)[1], _split(spark, sf)[0]).select("event_id", "publish_ts", "source"),
    "biz_date": lambda spark, sf: news(spark, sf).groupBy(search.local_date(F.col("publish_ts")).alias("biz_date")).agg(F.count(F.lit(1)).alias("n")),
    "dedup_text": lambda spark, sf: table(spark, sf, "documents").select("doc_id", X.dedup_text(F.col("text")).alias("text")).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("length")),
    "dedup_text_feeds": lambda spark, sf: table(spark, sf, "events").select("event_id", X.dedup_text(_sited(F.concat("event_type", F.lit(" "), "props"), F.col("event_id"))).alias("text")),
    "dedup_title_ok": lambda spark, sf: _text(spark, sf).select("event_id", X.dedup_title_ok(_titles()).alias("ok")),
    "dedup_keys": lambda spark, sf: story_dedup.key_rows(news(spark, sf)).select("event_id", F.md5("key").alias("key_md5")),
    "dedup_key_overlap": lambda spark, sf: story_dedup.shared_key_pairs(news(spark, sf)).select(F.md5("key").alias("key_md5"), "n_rows", "first_id"),
    "story_dedup_transitive": lambda spark, sf: story_dedup.transitive(news(spark, sf)).select("event_id", "component", "source"),
    "story_dedup_greedy": lambda spark, sf: story_dedup.greedy(news(spark, sf)).select("event_id", "publish_ts", "source"),
    "norm_sector": lambda spark, sf: _text(spark, sf).select("event_id", _name().alias("raw")).select("event_id", X.norm_sector(F.col("raw")).alias("sector")),
    "infer_sectors": lambda spark, sf: _text(spark, sf).select("event_id", F.array_join(X.infer_sectors(_told()), ",").alias("sectors")),
    "norm_sector_list": lambda spark, sf: _text(spark, sf).select("event_id", F.array_join(X.norm_sector_list(_items(), _told(), _subjects()), ",").alias("sectors")),
    "score_postprocess": lambda spark, sf: _text(spark, sf).withColumn("said", _said()).select(
        "event_id", X.direction(F.col("said")).alias("direction"), X.strong_event(F.col("said")).alias("strong"), X.score_postprocess(F.when(F.col("score") < 0, 0).otherwise(F.col("score") * 3), F.col("sectors"), F.col("said")).alias("score"),
        X.needs_repair(F.col("said"), F.col("sectors"), F.when(F.col("score") % 3 != 0, F.col("sectors")), F.col("score")).alias("needs_repair"),
    ),
    "analysis_payload": lambda spark, sf: _text(spark, sf).select("event_id", X.analysis_payload(_answer(), F.lit("无"), F.array(F.lit("银行"))).alias("p")).select("event_id", "p.score", "p.reason", F.array_join("p.companies", ",").alias("companies"), F.array_join("p.sectors", ",").alias("sectors")),
    "extract_json": lambda spark, sf: table(spark, sf, "events").select("event_id", F.from_json(X.extract_json(_fenced()), "k int")["k"].alias("k"), X.coerce_int(F.col("props")).alias("first_int")),
    "coerce_list": lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.size(F.coalesce(X.coerce_list(F.col("text")), F.array().cast("array<string>"))).alias("n_parts")),
    "fmt_num": lambda spark, sf: table(spark, sf, "events").select("event_id", X.fmt_num(F.col("value")).alias("shown")),
    "join_list": lambda spark, sf: news(spark, sf).select("event_id", X.join_list(F.when(F.col("score") > 0, F.array(F.lit(" "), F.concat(F.lit(" "), "title"), F.col("source")))).alias("shown")),
    "date_texts": lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.normalize_date(_date_text()).alias("day")),
    "safe_casts": lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.safe_float(_number(), 1.5).alias("as_float"), X.safe_int(_number(), 7).alias("as_int"), X.positive_int(_number(), 1).alias("positive"), X.non_negative_int(_number()).alias("non_negative")),
    "md_escape": lambda spark, sf: table(spark, sf, "pages").select("page_id", F.md5(X.md_escape(F.col("html"))).alias("escaped_md5")),
    "normalize_dates": lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.iso_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("day")),
}

def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values, n: str) -> str:
    return f"{_list(values)}[({n}) % {len(values)} + 1]"


def _held(text: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"


_N = "event_id::BIGINT"
_SITED = f"""({_pick(("", "财联社1月12日电，", "金十数据3月4日讯:", "[金十数据]", "财联社：", "同花顺9月30日讯，", "[同花顺],", "头 金十数据1月2日讯，"), "event_id")} || event_type || ' ' || coalesce(props, '') || {_pick(("", " - 金十数据 ", "—财联社", " 金十数据", "财联社", " — 同花顺", "同花顺", "（同花顺） ", "“引”"), "event_id // 3")})"""
_SPREAD = "substr({x}, 1, 1) || '、 ' || substr({x}, 2, 20)"
_NAME = f"""(CASE {_N} // 90 % 9 WHEN 0 THEN '　' || {_pick(X.SECTORS, _N)} WHEN 1 THEN '某' || {_pick(X.SECTORS, _N)} || '公司' WHEN 2 THEN {_SPREAD.format(x=_pick(X.SECTORS, _N))}
  WHEN 3 THEN {_SPREAD.format(x=_pick(tuple(X.ALIASES), _N))}
  WHEN 4 THEN '近期' || {_pick(tuple(X.ALIASES), _N)} || '板块' WHEN 5 THEN 'x' || event_id WHEN 6 THEN ' ' WHEN 8 THEN 'ETF-' || {_pick(tuple(X.ALIASES), _N)} END)"""


def _norm(raw0: str) -> str:
    """The five look-ups over the lists as they stand, in SQL."""
    raw = f"trim({raw0}, ' 　')"
    compact = f"regexp_replace({raw}, '[\\s、，,/；;（）()_—\\\\\\]]+', '', 'g')"
    keys, values = _list(X.ALIASES), _list(X.ALIASES.values())
    return f"""CASE WHEN coalesce({raw}, '') <> '' THEN coalesce(CASE WHEN list_contains({_list(X.SECTORS)}, {raw}) THEN {raw} END, list_filter({_list(X.SECTORS)}, lambda
  s: contains({raw}, s))[1], CASE WHEN list_contains({_list(X.SECTORS)}, {compact}) THEN {compact} END,
  {values}[list_position({keys}, {compact})], {values}[list_position({keys}, list_filter({keys}, lambda a: contains({raw}, a) OR contains({compact}, a))[1])]) END"""


_TOLD = f"""concat_ws('，', '报道', {_pick(_words(), _N)}, CASE WHEN {_N} % 3 > 0 THEN lower({_pick(_words(), _N + " * 7 + 3")}) END, CASE WHEN {_N} % 3 > 1 THEN {_pick(_words(), _N + " * 11 + 5")} END, CASE WHEN {_N} % 5 = 0 THEN {_pick(_words(), _N + " * 13 + 9")} END)"""
_INFER = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(told, '(?i){p}') THEN '{x}' END" for p, x in X.CONTENT_RULES) + "], lambda x: x IS NOT NULL)[1:3]"
_SAID = f"""concat_ws(' ', CASE WHEN {_N} % 3 <> 2 THEN {_pick(X.POSITIVE, _N)} END, CASE WHEN {_N} % 4 = 1 THEN {_pick(X.NEGATIVE, _N)} END, CASE WHEN {_N} % 8 =
  3 THEN {_pick(X.NEGATIVE, _N + " * 3 + 1")} END, CASE WHEN {_N} % 5 = 0 THEN {_pick(X.OFFICIAL, _N)} END,
  CASE WHEN {_N} % 7 = 0 THEN '8%' END, CASE WHEN {_N} % 9 = 0 THEN {_pick(X.HARD_EVENTS, _N)} END, title)"""
_CUT = ASOF - 15 * 86400
ORACLES = {
    "deep_page": f"WITH {NEWS} SELECT event_id, publish_ts, title, score FROM news ORDER BY publish_ts DESC, event_id LIMIT 60 OFFSET 7000",
    "upsert_news": f"""WITH {NEWS} SELECT event_id, publish_ts, source, CASE WHEN publish_ts >= {_CUT - 3 * 86400} THEN title || '!' ELSE title END AS title, (CASE WHEN publish_ts
  >= {_CUT - 3 * 86400} THEN score + 1 ELSE score END)::INT AS score FROM news""",
    "upsert_daily_doc": f"""WITH {NEWS}, d AS (SELECT {_LOCAL}::DATE AS biz_date, count(*) AS n FROM news GROUP BY 1)
SELECT biz_date, CASE WHEN biz_date > DATE '2024-01-10' THEN n * 2 ELSE n END AS n, CASE WHEN biz_date < DATE '2024-01-20' THEN 'first' ELSE 'second' END
  AS created_at, CASE WHEN biz_date > DATE '2024-01-10' THEN 'second' ELSE 'first' END AS updated_at FROM d""",
    "news_search": f"WITH {NEWS} SELECT event_id, publish_ts, title, score FROM news WHERE {_FOUND} ORDER BY publish_ts DESC, event_id LIMIT 40 OFFSET 5",
    "news_count": f"WITH {NEWS} SELECT count(*) AS n FROM news WHERE {_FOUND}",
    "news_by_sector": f"WITH {NEWS} SELECT event_id, publish_ts FROM news WHERE list_contains(sectors, 'U7') ORDER BY publish_ts DESC, event_id LIMIT 30",
    "news_by_id": f"WITH {NEWS} SELECT event_id, publish_ts, source, title, score FROM news WHERE event_id = '77'",
    "news_latest": f"""WITH {NEWS} SELECT event_id, publish_ts, source, title, content, score, array_to_string(sectors, ',') AS sectors, array_to_string(companies, ',') AS companies
  FROM news ORDER BY publish_ts DESC, event_id LIMIT 100""",
    "news_recent": f"""WITH {NEWS} SELECT event_id, publish_ts, strftime({_LOCAL}, '%Y-%m-%d %H:%M:%S') AS publish_time, title, source, score, {_SENTIMENT} AS sentiment FROM
  news WHERE publish_ts BETWEEN {ASOF - 3 * 86400} AND {ASOF}""",
    "hours_back": f"WITH {NEWS} SELECT event_id, publish_ts FROM news WHERE publish_ts BETWEEN {ASOF - 7200 - 86400} AND {ASOF - 7200} ORDER BY publish_ts DESC, event_id LIMIT 50",
    "score_tag": f"WITH {NEWS} SELECT event_id, CASE WHEN score > 60 THEN '利好' WHEN score < -60 THEN '利空' ELSE '中性' END AS tag, {_SENTIMENT} AS sentiment FROM news",
    "top_companies": f"WITH {NEWS} SELECT item, count(*) AS n FROM (SELECT unnest(companies) AS item FROM news) GROUP BY item ORDER BY n DESC, item LIMIT 10",
    "top_sectors": f"WITH {NEWS} SELECT item, count(*) AS n FROM (SELECT unnest(sectors) AS item FROM news) GROUP BY item ORDER BY n DESC, item LIMIT 10",
    "news_totals": f"WITH {NEWS} SELECT count(*) AS total, count(*) FILTER ({_LOCAL}::DATE = DATE '2024-01-31') AS today FROM news",
    "sentiment_share": f"""WITH {NEWS} SELECT sentiment, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM (SELECT {_SENTIMENT} AS sentiment FROM news WHERE {_FOUND})
  GROUP BY sentiment""",
    "latest_cursor": f"WITH {NEWS} SELECT source, count(*) AS n, max(publish_ts) AS latest_ts FROM news GROUP BY source",
    "new_events_only": f"WITH {NEWS} SELECT event_id, publish_ts FROM news WHERE publish_ts >= {ASOF - 15 * 86400}",
    "after_cursor": f"""WITH {NEWS}, c AS (SELECT source, max(publish_ts) AS newest FROM news WHERE publish_ts < {ASOF - 15 * 86400} GROUP BY source) SELECT event_id, publish_ts,
  source FROM news LEFT JOIN c USING (source) WHERE publish_ts >= {ASOF - 16 * 86400} AND (newest IS NULL OR publish_ts >= newest)""",
    "biz_date": f"WITH {NEWS} SELECT {_LOCAL}::DATE AS biz_date, count(*) AS n FROM news GROUP BY 1",
    "dedup_text": f"WITH t AS (SELECT doc_id, {_noise_sql('text')} AS text FROM documents) SELECT doc_id, md5(text) AS text_md5, length(text)::INT AS length FROM t",
    "dedup_text_feeds": f"SELECT event_id, {_noise_sql(_SITED)} AS text FROM events",
    "dedup_title_ok": f"""WITH {NEWS}, t AS (SELECT event_id, trim({_pick(("  ", "金十图示", "新闻联播今日要点", "今日要点", "金十数据", "快讯", "财联社", "五个字的题", "六个字的标题"), "event_id::BIGINT")} || CASE
  WHEN event_id::BIGINT % 2 = 0 THEN '一二三' ELSE '　' END, ' 　') AS t FROM news)
SELECT event_id, length(t) >= 6 AND NOT (starts_with(t, '金十图示') OR starts_with(t, '新闻联播今日要点') OR t IN ('今日要点', '金十数据', '财联社', '快讯')) AS ok FROM t""",
    "dedup_keys": f"WITH {NEWS}, {_KEYS} SELECT event_id, md5(key) AS key_md5 FROM keys",
    "dedup_key_overlap": f"WITH {NEWS}, {_KEYS} SELECT md5(key) AS key_md5, count(*) AS n_rows, min(event_id) AS first_id FROM keys GROUP BY key HAVING count(*) > 1",
    "norm_sector": f"WITH {NEWS}, r AS (SELECT event_id, {_NAME} AS raw0 FROM news) SELECT event_id, {_norm('raw0')} AS sector FROM r",
    "infer_sectors": f"WITH {NEWS}, r AS (SELECT event_id, {_TOLD} AS told FROM news) SELECT event_id, array_to_string({_INFER}, ',') AS sectors FROM r",
    "norm_sector_list": f"""WITH {NEWS}, r AS (SELECT event_id, event_id::BIGINT AS n, {_TOLD} AS told, {_norm(_NAME)} AS named, {_norm(_pick(tuple(X.ALIASES), "event_id::BIGINT"))}
  AS aliased, {_pick(X.SECTORS, "event_id::BIGINT * 3")} AS s3, {_pick(X.SECTORS, "event_id::BIGINT * 5")} AS s5, {_pick(X.SECTORS, "event_id::BIGINT * 7")}
  AS s7 FROM news),
l AS (SELECT event_id, told, CASE WHEN n % 4 < 2 THEN [named, s3, s5, s7] WHEN n % 4 = 2 THEN [aliased, named] ELSE [] END AS xs FROM r),
d AS (SELECT event_id, told, list_filter(xs, lambda x, i: x IS NOT NULL AND list_position(xs, x) = i)[1:3] AS xs FROM l) SELECT event_id, CASE WHEN len(xs)
  > 0 THEN array_to_string(xs, ',') WHEN len({_INFER}) > 0 THEN array_to_string({_INFER}, ',') END AS sectors FROM d""",
    "score_postprocess": f"""WITH {NEWS}, s AS (SELECT event_id, score, sectors, {_SAID} AS said FROM news), w AS (SELECT *, {_held("said", X.POSITIVE)} AS pos, {_held("said", X.NEGATIVE)}
  AS neg, {_held("said", X.OFFICIAL)} AS off, {_held("said", X.HARD_EVENTS)} AS hard FROM s),
v AS (SELECT *, sign(pos - neg)::INT AS direction, (pos + neg > 0 AND (off > 0 OR regexp_matches(said, '[0-9]'))) OR hard > 0 AS strong, greatest(-100,
  least(100, CASE WHEN score < 0 THEN 0 ELSE score * 3 END)) AS clamped, CASE WHEN score % 3 <> 0 THEN sectors END AS kept FROM w)
SELECT event_id, direction, strong, (CASE WHEN clamped = 0 AND sectors IS NOT NULL AND direction <> 0 THEN direction * CASE WHEN strong THEN 35 ELSE 15 END ELSE clamped END)::INT AS score,
  (sectors IS NOT NULL AND kept IS NULL) OR (kept IS NOT NULL AND score = 0) OR (kept IS NOT NULL AND strong AND abs(score) < 45) AS needs_repair FROM v""",
    "analysis_payload": f"""WITH {NEWS}, k AS (SELECT event_id, event_id::BIGINT AS n FROM news),
a AS (SELECT event_id, n, [7, -100, 0, -12, 2, 4, 0, -8, 0, 99, 0, 1][n % 12 + 1] AS score, ['why', '{X.NO_REASON}', '{X.NO_REASON}', 'r'][n % 4 + 1] AS
  reason, ['甲,乙', '丙,丁', NULL, NULL, NULL, NULL][n % 6 + 1] AS companies, ['半导体,白酒', '半导体,银行', '银行', '银行', '养殖业', '银行'][n // 12 % 6 + 1] AS sectors FROM
  k)
SELECT event_id, CASE WHEN n % 5 < 4 THEN score END AS score, CASE WHEN n % 5 < 4 THEN reason END AS reason, CASE WHEN n % 5 < 4 THEN companies END AS
  companies, CASE WHEN n % 5 < 4 THEN sectors END AS sectors FROM a""",
    "extract_json": "SELECT event_id, (props->>'$.k')::INT AS k, regexp_extract(props, '-?[0-9]+')::BIGINT AS first_int FROM events",
    "coerce_list": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[、，,;/；\\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))::INT AS n_parts FROM documents",
    "fmt_num": "SELECT event_id, regexp_replace(regexp_replace(printf('%.3f', value), '0+$', ''), '\\.$', '') AS shown FROM events",
    "join_list": f"WITH {NEWS} SELECT event_id, CASE WHEN score > 0 THEN title || '、' || source ELSE 'None' END AS shown FROM news",
    "date_texts": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN year(o_orderdate)
  || '/' || month(o_orderdate) || '/' || day(o_orderdate) END AS day FROM orders""",
    "safe_casts": """WITH t AS (SELECT o_orderkey AS k, o_orderkey % 5 AS m FROM orders) SELECT k AS o_orderkey, CASE m WHEN 0 THEN k WHEN 1 THEN -k WHEN 3 THEN k + 0.75::DOUBLE
  ELSE 1.5::DOUBLE END::DOUBLE AS as_float, CASE m WHEN 0 THEN k WHEN 1 THEN -k WHEN 3 THEN k ELSE 7 END AS as_int,
  CASE WHEN m IN (0, 3) AND k > 0 THEN k WHEN m IN (2, 4) THEN 1 ELSE 1 END AS positive, CASE m WHEN 0 THEN k WHEN 3 THEN k ELSE 0 END AS non_negative FROM t""",
    "md_escape": "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages",
    "normalize_dates": "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders",
}


def _transitive_sql() -> str:
    """Least labels spread over rows and keys in a fixed number of rounds, enough for the longest chain of these tables."""
    rounds, last = [], "l0"
    for i in range(1, 7):
        rounds.append(f"""b{i} AS (SELECT key, min(label) AS label FROM keys JOIN {last} USING (event_id) GROUP BY key),
l{i} AS (SELECT event_id, min(label) AS label FROM keys JOIN b{i} USING (key) GROUP BY event_id)""")
        last = f"l{i}"
    return f"""WITH {NEWS}, {_KEYS}, l0 AS (SELECT DISTINCT event_id, event_id AS label FROM keys), {", ".join(rounds)}
SELECT event_id, component, source FROM (SELECT news.event_id, coalesce(label, news.event_id) AS component, source,
  row_number() OVER (PARTITION BY coalesce(label, news.event_id) ORDER BY length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) DESC, (source = 'cls')::INT DESC, publish_ts DESC,
    CASE source WHEN 'cls' THEN 1 WHEN 'jin10' THEN 2 ELSE 3 END, news.event_id) AS place FROM news LEFT JOIN {last} USING (event_id)) WHERE place = 1"""


ORACLES["story_dedup_transitive"] = _transitive_sql()


def _greedy_sql(rounds: int = 8) -> str:
    """Homes of rows in order of arrival: each round a row takes the least home that its keys had before it; more rounds than
    these tables need."""
    steps, last = [], "h0"
    for i in range(1, rounds + 1):
        steps.append(f"""w{i} AS (SELECT event_id, min(home) OVER (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ka JOIN {last} USING (event_id)),
h{i} AS (SELECT event_id, least({last}.home, coalesce(min(before), {last}.home)) AS home FROM {last} JOIN w{i} USING (event_id) GROUP BY event_id, {last}.home)""")
        last = f"h{i}"
    return f"""WITH {NEWS}, {_KEYS}, arr AS (SELECT event_id, row_number() OVER (ORDER BY publish_ts, CASE source WHEN 'cls' THEN 1 WHEN 'jin10' THEN 2 ELSE 3 END, event_id) AS place FROM news),
ka AS (SELECT event_id, key, place FROM keys JOIN arr USING (event_id)), h0 AS (SELECT DISTINCT event_id, place AS home FROM ka), {", ".join(steps)},
best AS (SELECT news.event_id, publish_ts, source, home, row_number() OVER (PARTITION BY home ORDER BY length(trim(content, ' ' || chr(9) || chr(10) ||
  chr(13))) DESC, (source = 'cls')::INT DESC, publish_ts DESC, place) AS rank FROM news JOIN arr USING (event_id) JOIN {last} USING (event_id))
SELECT event_id, publish_ts, source FROM best WHERE rank = 1 UNION ALL SELECT event_id, publish_ts, source FROM news WHERE event_id NOT IN (SELECT event_id FROM keys)"""


ORACLES["story_dedup_greedy"] = _greedy_sql()
