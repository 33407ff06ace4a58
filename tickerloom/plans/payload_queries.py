"""Registered queries over landed payloads and panels, with their oracle SQL; payloads are made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import payloads as Y
from tickerloom.functions.newstext import SECTORS, normalize_date
from tickerloom.operators import panels as N
from tickerloom.operators import search
from tickerloom.sources.scratch import scratch_table
from tickerloom.sources.views import ASOF, BARS, NEWS, bars_supp, news, table

_FEED_PARTS = ("roll_data", "data", "list", "bare")


def _bodies(spark, sf):
    """A JSON body per news row: items at four places, ids, times in seconds or milliseconds and subjects of mixed quality."""
    n = F.col("event_id").cast("long")
    rows = news(spark, sf).where("source = 'cls'").withColumn("n", n)
    item = F.struct(
        F.when(n % 3 == 0, F.col("event_id")).when(n % 3 == 1, F.lit("")).alias("id"),
        F.when(n % 4 == 1, F.concat(F.lit(" "), "title")).otherwise("").alias("title"),
        F.concat(F.when(n % 2 == 0, F.concat(F.lit("【 lead "), "title", F.lit(" 】 "))).otherwise(""), "content").alias("content"),
        F.when(n % 7 == 3, F.lit("soon")).when(n % 5 == 0, F.lit("")).when(n % 5 == 1, F.lit("0")).when(n % 5 == 2, (F.col("publish_ts") * 1000 + 12).cast("string")).otherwise(F.col("publish_ts").cast("string")).alias("ctime"),
        F.col("publish_ts").cast("string").alias("time"),
        F.array(*[F.struct(x.alias("subject_name")) for x in (F.concat(F.lit(" "), "title"), F.lit(""), F.col("title"), F.lit(None).cast("string"), F.concat(F.lit("s"), (n % 4).cast("string")))]).alias("subjects"),
    )
    items = F.array(item)
    shapes = [F.to_json(F.struct(F.struct(items.alias(p)).alias("data"))) for p in _FEED_PARTS[:3]] + [F.to_json(F.struct(items.alias("data")))]
    body = F.when(n % 4 == 0, shapes[0]).when(n % 4 == 1, shapes[1]).when(n % 4 == 2, shapes[2]).otherwise(shapes[3])
    return rows.select(F.when(n % 11 == 5, F.lit('{"data": 3}')).when(n % 11 == 6, F.lit("not json")).otherwise(body).alias("body"))


_BODIES = """bodies AS (SELECT *, event_id::BIGINT AS n FROM news WHERE source = 'cls' AND event_id::BIGINT % 11 NOT IN (5, 6) AND event_id::BIGINT % 7 <> 3)"""


def _pages(spark, sf):
    """Flash pages: navigation words, times, titles and documents as contents, now and then with a time where a title should be."""
    n = F.col("doc_id")
    clock = F.concat(F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))
    word = F.element_at(F.array(*map(F.lit, Y.SKIP_WORDS)), (n % len(Y.SKIP_WORDS) + 1).cast("int"))
    first = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ")
    lines = F.array(F.lit("滚动快讯"), clock, word, F.lit("重要"), F.concat(F.lit("## 题 "), n.cast("string")), F.concat(F.lit(" 文  "), first), F.lit(""), clock, F.concat(F.lit("## 题 "), n.cast("string")), F.concat(F.lit("文 "), first), F.lit("12:30:45"), F.when(n % 3 == 0, F.lit("12:31")).otherwise("A"), F.lit("B"), F.lit("C"), F.lit("23:59"), F.lit("last"))
    return table(spark, sf, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.array_join(lines, "\n").alias("text"))


def _feed(spark, sf):
    """Stories of the second feed in all the forms their pages give them."""
    n = F.col("event_id").cast("long")
    at = F.from_utc_timestamp(F.timestamp_seconds("publish_ts"), "Asia/Shanghai")
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" 周日 "), F.date_format(at, "HH:mm:ss"))
    dateline = F.concat(F.lit("金十数据"), F.month(at).cast("string"), F.lit("月"), F.dayofmonth(at).cast("string"), F.lit("日讯，"))
    title = F.concat(F.lit("标题"), "title", n.cast("string"))
    body = F.concat(F.lit("正文"), n.cast("string"), F.lit("  tells  "), "title")
    content = (
        F.when(n % 5 == 0, F.concat(F.lit("首页 快讯详情 【"), title, F.lit("】"), body))
        .when(n % 5 == 1, F.concat(title, F.lit(" "), dateline, body, F.lit(" - 金十数据")))
        .when(n % 5 == 2, F.concat(body, F.lit(" - 金十数据 "), stamp, F.lit(" "), title, F.lit(" "), body))
        .when(n % 5 == 3, F.concat(F.lit("金十数据："), body, F.lit(" 分享 收藏 详情 复制 金十数据")))
        .otherwise("")
    )
    summary = F.when(n % 4 == 0, F.lit("分享 详情")).when(n % 4 == 1, F.concat(F.lit("摘要"), n.cast("string"))).when(n % 4 == 2, F.lit("2024-01-01 x")).otherwise(F.repeat(F.lit("长"), 90))
    return news(spark, sf).select("event_id", "publish_ts", content.alias("content"), summary.alias("summary"), F.when(n % 2 == 0, stamp).alias("stamp"), F.when(n % 6 < 5, F.date_format(at, "HH:mm:ss")).alias("clock"))


_FEED = """fd AS (SELECT event_id, publish_ts, event_id::BIGINT AS n, (to_timestamp(publish_ts) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR) AS lt, '标题' || title || event_id AS title, '正文' || event_id || ' tells ' || title AS body FROM news)"""


def _quotes(spark, sf):
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    blank = lambda c, m: F.when(k % m == 1, F.lit("-")).when(k % m == 2, F.lit("--")).when(k % m == 3, F.lit("")).otherwise(c.cast("string"))
    price = F.col("p_retailprice")
    numbers = {f: blank(price + i, 5 + i) for i, f in enumerate(Y.QUOTE_FIELDS)}
    numbers["f2"] = F.when(k % 19 == 0, F.lit("0")).otherwise(numbers["f2"])
    return part.select(F.when(k % 13 != 5, F.lpad(k.cast("string"), 6, "0")).alias("f12"), F.when(k % 17 != 5, F.col("p_name")).otherwise("").alias("f14"), *[v.alias(f) for f, v in numbers.items()])


def _quotes_sql() -> str:
    fields = []
    for i, (f, c) in enumerate(Y.QUOTE_FIELDS.items()):
        value = f"CASE WHEN p_partkey % {5 + i} IN (1, 2, 3) THEN NULL ELSE (p_retailprice + {i})::DOUBLE END"
        fields.append(f"CASE WHEN p_partkey % 19 = 0 THEN 0::DOUBLE ELSE {value} END AS {c}" if f == "f2" else f"{value} AS {c}")
    return f"SELECT lpad(p_partkey::VARCHAR, 6, '0') AS symbol, p_name AS name, {', '.join(fields)} FROM part WHERE p_partkey % 13 <> 5 AND p_partkey % 17 <> 5"


def _histories(spark, sf):
    bars = bars_supp(spark, sf)
    line = F.concat_ws(",", F.col("trade_date").cast("string"), *[F.when(F.month("trade_date") == 7, F.lit("-")).otherwise(F.col(c).cast("string")) if c == "close" else F.col(c).cast("string") for c in ("open", "close", "high", "low")], *map(F.lit, ("9", "12.5", "NaN", "", "0.5", "3")))
    short = F.when(F.month("trade_date") == 2, F.lit("1999-01-01,1,2")).otherwise(line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("trade_date", short.alias("line")))), lambda x: x["line"])
    return bars.groupBy("symbol").agg(lines.alias("lines")).withColumn("name", F.concat(F.lit("N"), "symbol"))


def _index_quotes(spark, sf):
    part = table(spark, sf, "part")
    code = F.element_at(F.array(*map(F.lit, ["1", "399001", "399006", "688", "300", "777777"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return part.groupBy(code.alias("f12")).agg(*[F.max("p_retailprice").cast("string").alias(f) for f in ("f2", "f3", "f4", "f15", "f16", "f17", "f18")])


def _mornings(spark, sf):
    """Morning texts with the markers of sections in and around the lines of documents."""
    n = F.col("doc_id")
    marks = list(Y.SECTIONS)
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")
    fifth = F.floor(F.length(flat) / 5).cast("int")
    # A fifth each, the last with what remains.
    piece = lambda i: F.substring(flat, F.lit(1) + fifth * i, fifth if i < 4 else F.length(flat))
    mark = lambda i: F.element_at(F.array(*map(F.lit, marks)), ((n + i) % 6 + 1).cast("int"))
    text = F.concat_ws("\n", piece(0), F.lit("  "), F.concat(F.lit("> "), mark(0), F.lit(" <")), piece(1), piece(2), mark(2), piece(3), mark(0), piece(4))
    return table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", text.alias("text"))


def _link_pages(spark, sf):
    n = F.col("page_id")
    name = F.element_at(F.array(*map(F.lit, SECTORS)), (n % 90 + 1).cast("int"))
    code = F.lpad((n % 90 + 881100).cast("string"), 6, "0")
    link = F.concat(F.lit('<a class="x" href="http://q.test/thshy/detail/code/'), code, F.lit('/" target=_b> <b>'), name, F.lit("</b> </a>"))
    empty = F.concat(F.lit('<a href="/thshy/detail/code/'), code, F.lit('"> </a>'))
    return table(spark, sf, "pages").select("page_id", F.concat(F.col("html"), link, empty).alias("html"))


def _docs(spark, sf):
    """A market document per row of documents, a day each, and its re-issue on every third, with nested sectors, stocks and a
    written analysis that begins with the row's text."""
    days = table(spark, sf, "documents").where("doc_id IS NOT NULL").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")).alias("analysis_date"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ").alias("flat"))
    k = F.datediff("analysis_date", F.lit("2024-01-01").cast("date"))
    sector = lambda i: F.element_at(F.array(*map(F.lit, SECTORS)), (F.pmod(k * 7 + i * 13, F.lit(90)) + 1).cast("int"))
    ordinals = "一二三四五"
    lines = []
    for i, o in enumerate(ordinals):
        lines.append(F.concat(F.lit(f"第{o}主线： " if i < 4 else f"第{o}主线："), F.when((k % 5 == 4) & F.lit(i == 4), F.lit("别的")).otherwise(sector(i)), F.lit("  ")))
        lines.append(F.when(F.lit(i) != 3, F.concat(F.lit("理由：because "), k.cast("string"), F.lit(f" of {i}"))).otherwise("no reason here"))
        lines.append(F.lit(f"  and more {i}"))
    text = F.when(k % 6 == 5, F.concat(F.lit("nothing clear today "), "flat")).otherwise(F.concat_ws("\n", F.concat(F.lit("开头 "), "flat"), *lines))
    stocks = lambda i: F.array(*[F.struct(F.when((k + j) % 4 == 0, F.lit(" ")).otherwise(F.lpad((k * 10 + i * 3 + j).cast("string"), 6, "0")).alias("code"), F.lit(f" name {i}{j} ").alias("name")) for j in range(3)])
    tops = F.array(*[F.struct((F.lit(i + 1)).alias("rank"), F.when((k + i) % 7 == 0, F.lit("")).otherwise(sector(i)).alias("sector_name"), stocks(i).alias("stocks")) for i in range(3)])
    mains = F.array(*[F.struct((F.lit(i + 1) if i != 1 else F.lit(None).cast("int")).alias("rank"), F.concat(F.lit(" "), sector(i)).alias("sector_name")) for i in range(5)])
    base = days.select("analysis_date", F.when(k % 4 != 3, F.date_add("analysis_date", 1)).alias("trade_date"), (k * 10).alias("updated_at"), mains.alias("mainline_sectors"), tops.alias("sector_top_stocks"), text.alias("analysis_text"))
    again = base.where(k % 3 == 0).withColumn("updated_at", F.col("updated_at") + 5).withColumn("trade_date", F.col("analysis_date"))
    return base.unionByName(again)


_SECTOR_LIST = "[" + ", ".join(f"'{s}'" for s in SECTORS) + "]"


def _sector_sql(i: int) -> str:
    return f"{_SECTOR_LIST}[(k * 7 + {i * 13}) % 90 + 1]"


def _docs_sql() -> str:
    """The documents of _docs, their lists as rows: main(i), top(i), stock(i, j); lines as a list."""
    lines = []
    for i, o in enumerate("一二三四五"):
        name = f"CASE WHEN k % 5 = 4 THEN '别的' ELSE {_sector_sql(i)} END" if i == 4 else _sector_sql(i)
        lines += [f"'第{o}主线：' || '{' ' if i < 4 else ''}' || {name} || '  '", f"'理由：because ' || k || ' of {i}'" if i != 3 else "'no reason here'", f"'  and more {i}'"]
    return f"""d0 AS (SELECT (DATE '2024-01-01' + doc_id::INT)::DATE AS analysis_date, doc_id AS k, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') AS flat
  FROM documents WHERE doc_id IS NOT NULL),
d1 AS (SELECT analysis_date, k, CASE WHEN k % 4 <> 3 THEN (analysis_date + 1)::DATE END AS trade_date, (k * 10)::INT AS updated_at, CASE WHEN k % 6 = 5
  THEN 'nothing clear today ' || flat ELSE array_to_string(['开头 ' || flat, {", ".join(lines)}], chr(10)) END AS analysis_text FROM d0),
docs AS (SELECT * FROM d1 UNION ALL SELECT analysis_date, k, analysis_date, updated_at + 5, analysis_text FROM d1 WHERE k % 3 = 0)"""


_REASONS = " UNION ALL ".join(
    f"SELECT analysis_date, updated_at, {i + 1} AS rank, {('CASE WHEN k % 5 = 4 THEN ' + chr(39) + '别的' + chr(39) + ' ELSE ' + _sector_sql(i) + ' END') if i == 4 else _sector_sql(i)} AS sector_name, {'CASE WHEN false THEN 1::VARCHAR ELSE ' + chr(39) + chr(39) + ' END' if i == 3 else f'{chr(39)}because {chr(39)} || k || {chr(39)} of {i}{chr(39)} || chr(10) || {chr(39)}and more {i}{chr(39)}'} AS reason FROM docs WHERE k % 6 <> 5"
    for i in range(5)
)


def _indices(spark, sf):
    """Index rows per row of documents, a day each: padded and short codes in changing order, repeats, 000300 and others."""
    days = table(spark, sf, "documents").where("doc_id IS NOT NULL").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")).alias("day"))
    k = F.datediff("day", F.lit("2024-01-01").cast("date"))
    codes = ["688", "899050", "300", "399001", "000016", "1", "399006", "000905", "399001", "000852", "000016"]
    rows = days.select("day", k.alias("k"), F.posexplode(F.array(*map(F.lit, codes))).alias("pos", "index_code")).where((F.col("k") + F.col("pos")) % 4 != 0)
    return rows.select("day", "pos", "index_code", F.concat(F.lit(" raw "), "index_code").alias("index_name"), (F.col("k") * 100 + F.col("pos")).alias("latest"))


_INDICES = """ix0 AS (SELECT (DATE '2024-01-01' + doc_id::INT)::DATE AS day, doc_id AS k FROM documents WHERE doc_id IS NOT NULL),
ix AS (SELECT day, p - 1 AS pos, lpad(c, 6, '0') AS code, ' raw ' || c AS raw, (k * 100 + p - 1)::INT AS latest FROM ix0, (SELECT unnest(['688', '899050',
  '300', '399001', '000016', '1', '399006', '000905', '399001', '000852', '000016']) AS c, generate_subscripts(['688', '899050', '300', '399001', '000016',
  '1', '399006', '000905', '399001', '000852', '000016'], 1) AS p) WHERE (k + p - 1) % 4 <> 0)"""


def _trials(spark, sf):
    k = F.col("o_orderkey")
    reason = F.when(k % 6 == 0, F.lit("case: warm-up 失败 (timeout)")).when(k % 6 == 1, F.lit("other"))
    return table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.when(k % 9 != 4, F.pmod(k, F.lit(7)).cast("int")).alias("success_pages"), F.pmod(k, F.lit(700)).cast("int").alias("total_rows"), (F.pmod(k, F.lit(64)) / 4).alias("total_cost_seconds"), reason.alias("failure_reason"), F.when(k % 5 < 3, k % 5 == 0).alias("stopped_by_expire"))


def _technical(spark, sf):
    """Results that end at three dates, two of them with no bar on the day, one before there are thirty; own input of one bar."""
    ends = F.array(*[F.lit(d).cast("date") for d in ("1996-02-10", "1998-06-15", "2005-01-01")])
    price = F.lit(1.0)
    bar = F.struct(F.lit("1990-01-01").cast("date").alias("trade_date"), *[price.alias(c) for c in ("open", "high", "low", "close")])
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("stock_code"), F.explode(ends).alias("kline_trade_date_end"), F.array(bar).alias("input_bars"))


def _panel(spark, sf):
    day = lambda c: c["trade_date"]
    return N.panel_bars(_technical(spark, sf), bars_supp(spark, sf)).select("stock_code", "kline_trade_date_end", F.size("kline").alias("n"), day(F.col("kline")[0]).alias("first_date"), F.col("snapshot")["trade_date"].alias("last_date"), F.col("snapshot")["close"].alias("close"))


def _rows_of_panels(spark, sf):
    n = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(n.alias("key"), F.when(n % 2 == 0, F.col("o_totalprice")).alias("open_price"), (F.col("o_totalprice") + 1).alias("open"), F.when(n % 3 == 0, F.lit("20240105")).alias("trade_date"), F.lit("2024-01-06").alias("date"), F.when(n % 4 == 0, F.lit("2024-03-01T01:30:00Z")).when(n % 4 == 1, F.lit("2024-03-01 09:30:00")).when(n % 4 == 2, F.lit("soon")).otherwise(" ").alias("analysis_time"))
    unified = N.panel_row(rows, {"key": ["key"], "open_price": ["open_price", "open"], "trade_date": ["trade_date", "date"], "pe_ratio": ["pe_ratio"], "analysis_time": ["analysis_time"]})
    return unified.select("key", "open_price", normalize_date(F.col("trade_date")).alias("trade_date"), F.col("pe_ratio").isNull().alias("no_ratio"), N.local_time_text(F.col("analysis_time")).alias("analysis_time"))


def _feeds_union(spark, sf):
    rows = news(spark, sf).select("event_id", "publish_ts", "source", "title")
    return search.feeds_union([rows.where(F.col("source") == s) for s in ("cls", "jin10", "10jqka")])


def _stories(spark, sf):
    """The second feed's stories, a third of them with the address of their page."""
    n = F.col("event_id").cast("long")
    return _feed(spark, sf).withColumn("detail_url", F.when(n % 3 == 0, F.concat(F.lit("https://flash.test/detail/"), "event_id")).when(n % 3 == 1, F.lit("")))


def _land_feeds(spark, sf):
    """News rows of all three feeds' payloads, in order of time."""
    feeds = [Y.news_items(_bodies(spark, sf)), Y.feed_news(_stories(spark, sf), ASOF), Y.flash_news(Y.flash_items(_pages(spark, sf)), ASOF)]
    digest = ("event_id", "publish_ts", "publish_time", F.array_join("subjects", ",").alias("subjects"), "title", F.md5("content").alias("content_md5"), "source")
    # Written before they are sorted: finding the ranges of a sort reads its rows once more.
    return search.feeds_union([scratch_table(rows.select(*digest)) for rows in feeds])


QUERIES = {
    "land_feeds": _land_feeds,
    "land_news_json": lambda spark, sf: Y.news_items(_bodies(spark, sf)).withColumn("subjects", F.array_join("subjects", ",")),
    "flash_lines": lambda spark, sf: Y.flash_items(_pages(spark, sf)),
    "jin10_clean": lambda spark, sf: _feed(spark, sf).select("event_id", Y.feed_content(F.col("content"), F.col("summary")).alias("content")),
    "jin10_title": lambda spark, sf: _feed(spark, sf).select("event_id", Y.feed_title(F.col("summary"), F.col("content")).alias("title")),
    "jin10_ts": lambda spark, sf: _feed(spark, sf).select("event_id", Y.feed_epoch(F.col("stamp"), F.col("clock"), ASOF).alias("ts")),
    "snapshot_from_vendor": lambda spark, sf: Y.quote_rows(_quotes(spark, sf)),
    "history_from_csv": lambda spark, sf: Y.history_rows(_histories(spark, sf)),
    "index_snapshot": lambda spark, sf: Y.index_rows(_index_quotes(spark, sf)).select("place", "index_code", "index_name", "latest", "prev_close", "missing"),
    "split_sections": lambda spark, sf: Y.sections(_mornings(spark, sf)).select("doc_id", "section", F.md5("body").alias("body_md5"), F.length("body").alias("length")),
    "sector_list_dedup": lambda spark, sf: Y.sector_links(_link_pages(spark, sf)),
    "sector_dim": lambda spark, sf: Y.with_sector_codes(N.pool_positions(_docs(spark, sf)), Y.sector_links(_link_pages(spark, sf))).select("analysis_date", "sector", "sector_code", "stock_code"),
    "mainlines": lambda spark, sf: _docs(spark, sf).select("analysis_date", "updated_at", F.array_join(N.mainlines(F.col("analysis_text")), ",").alias("names"), N.mainlines_valid(F.col("analysis_text")).alias("valid")),
    "mainline_reasons": lambda spark, sf: N.mainline_reasons(_docs(spark, sf).withColumn("key", F.struct("analysis_date", "updated_at")), "key").select("key.*", "rank", "sector_name", "reason"),
    "digest_lines": lambda spark, sf: _docs(spark, sf).select("analysis_date", "updated_at", F.md5(N.digest_lines(F.col("analysis_text"))).alias("digest_md5")),
    "market_doc_latest": lambda spark, sf: N.docs_recent(_docs(spark, sf), 1).select("analysis_date", "trade_date", "updated_at"),
    "market_docs_recent": lambda spark, sf: N.docs_recent(_docs(spark, sf), 7).select("analysis_date", "trade_date", "updated_at"),
    "market_doc_by_date": lambda spark, sf: N.docs_by_date(_docs(spark, sf), "analysis_date").select("analysis_date", "trade_date", "updated_at"),
    "doc_fallback": lambda spark, sf: N.docs_for(_docs(spark, sf), spark.read.parquet(f"{sf}/events.parquet").select(F.date_add(F.to_date("ts"), 3).alias("day")).distinct()).select("day", "analysis_date", "trade_date", "updated_at"),
    "morning_panel": lambda spark, sf: N.morning_panel(N.docs_by_date(_docs(spark, sf), "analysis_date")),
    "pool_positions": lambda spark, sf: N.pool_positions(_docs(spark, sf).where("updated_at % 10 = 0")),
    "index_panel": lambda spark, sf: N.index_panel(_indices(spark, sf), "day").select("day", "place", "index_code", "index_name", "latest"),
    "panel_bars": _panel,
    "panel_rows": _rows_of_panels,
    "trial_summary": lambda spark, sf: N.trial_summary(_trials(spark, sf), ["o_orderpriority", "o_orderstatus"]),
    "feeds_union": _feeds_union,
}

_LOCAL = "(to_timestamp(publish_ts) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR)"
_SKIPPED = ", ".join(f"'{w}'" for w in Y.SKIP_WORDS)
_POOL_ROWS = " UNION ALL ".join(
    f"SELECT analysis_date, updated_at, {_sector_sql(i)} AS sector, {i + 1} AS sector_rank, {j + 1} AS stock_rank, lpad((k * 10 + {i * 3 + j})::VARCHAR, 6, '0') AS stock_code, 'name {i}{j}' AS stock_name FROM docs WHERE (k + {i}) % 7 <> 0 AND (k + {j}) % 4 <> 0"
    for i in range(3)
    for j in range(3)
)
_MARKS = "[" + ", ".join(f"'{s}'" for s in Y.SECTIONS.values()) + "]"
_FOUND_INDEX = "CASE code " + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(Y.INDICES)) + " ELSE 6 END"
_INDEX_NAMES = "CASE code " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in Y.INDICES.items()) + " ELSE trim(raw) END"
_LINKS = f"links AS (SELECT DISTINCT {_SECTOR_LIST}[page_id % 90 + 1] AS sector_name, lpad((page_id % 90 + 881100)::VARCHAR, 6, '0') AS sector_code FROM pages)"
_TITLED = "CASE WHEN n % 4 = 1 THEN title WHEN n % 2 = 0 THEN 'lead ' || title ELSE '' END"
ORACLES = {
    "land_news_json": f"""WITH {NEWS}, {_BODIES}, t AS (SELECT n, publish_ts, {_TITLED} AS shown, CASE WHEN n % 2 = 0 THEN ltrim(content, ' ' || chr(9) || chr(10) || chr(13)) ELSE
  content END AS told, title FROM bodies),
u AS (SELECT *, trim(told, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM t)
SELECT CASE WHEN n % 3 = 0 THEN n::VARCHAR ELSE md5(publish_ts || '+' || shown || '+' || body || '+cls') END AS event_id, publish_ts, strftime({_LOCAL},
  '%H:%M:%S') AS publish_time, title || ',s' || (n % 4) AS subjects, shown AS title, body AS content, 'cls' AS source FROM u""",
    "flash_lines": f"""WITH p AS (SELECT doc_id, lpad((doc_id % 24)::VARCHAR, 2, '0') || ':' || lpad((doc_id % 60)::VARCHAR, 2, '0') AS clock, '题 ' || doc_id AS title,
  trim(regexp_replace('文 ' || regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g'), '[ \\t\\x0B\\f\\x{{a0}}]+', ' ', 'g')) AS content FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id AS page_id, clock, title, content, 1 AS pos FROM p
UNION ALL SELECT doc_id, '12:30:45', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'A' END, 'B', 10 FROM p WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, '12:31',
  'B', 'C', 11 FROM p WHERE doc_id % 3 = 0""",
    "jin10_clean": f"""WITH {NEWS}, {_FEED} SELECT event_id, CASE WHEN n % 5 < 4 THEN body WHEN n % 4 = 0 THEN '分享 详情' WHEN n % 4 = 1 THEN '摘要' || n WHEN n % 4 = 2 THEN '2024-01-01 x'
  ELSE repeat('长', 90) END AS content FROM fd""",
    "jin10_title": f"WITH {NEWS}, {_FEED} SELECT event_id, CASE WHEN n % 5 = 1 THEN title WHEN n % 4 = 1 THEN '摘要' || n ELSE '' END AS title FROM fd",
    "jin10_ts": f"""WITH {NEWS}, {_FEED} SELECT event_id, CASE WHEN n % 2 = 0 THEN publish_ts WHEN n % 6 < 5 THEN {ASOF - (ASOF + 28800) % 86400} + (hour(lt) * 3600 + minute(lt)
  * 60 + second(lt)) END::BIGINT AS ts FROM fd""",
    "snapshot_from_vendor": f"SELECT *, CASE WHEN close_price <> 0 THEN float_market_cap_yuan / close_price END AS float_shares FROM ({_quotes_sql()})",
    "history_from_csv": f"""WITH {BARS}, h AS (SELECT symbol, trade_date, open AS open_price, CASE WHEN month(trade_date) <> 7 THEN close END AS close_price, high AS high_price, low
  AS low_price FROM bars_supp WHERE month(trade_date) <> 2)
SELECT symbol, 'N' || symbol AS name, trade_date, open_price, close_price, high_price, low_price, 12.5::DOUBLE AS turnover_amount_yuan, NULL::DOUBLE AS
  amplitude_percent, NULL::DOUBLE AS change_percent, 0.5::DOUBLE AS change_amount, 3::DOUBLE AS turnover_percent,
  lag(close_price) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev_close_price FROM h""",
    "index_snapshot": """WITH q AS (SELECT ['000001', '399001', '399006', '000688', '000300', '777777'][p_partkey % 6 + 1] AS code, max(p_retailprice)::DOUBLE AS latest FROM part GROUP BY 1)
SELECT place::INT AS place, w.code AS index_code, w.name AS index_name, latest, latest AS prev_close, latest IS NULL AS missing FROM (VALUES (1, '000001',
  '上证指数'), (2, '399001', '深证成指'), (3, '399006', '创业板指'), (4, '000688', '科创50'), (5, '899050', '北证50')) AS w(place, code, name) LEFT JOIN q USING (code)""",
    "split_sections": f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') AS x FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, i, trim(substr(x, 1 + length(x) // 5 * i, CASE WHEN i < 4 THEN length(x) // 5 ELSE length(x) END), ' ' || chr(9) || chr(11) || chr(12)
  || chr(160) || chr(12288)) AS line, CASE WHEN i = 0 THEN 'head' WHEN i = 3 THEN {_MARKS}[(doc_id + 2) % 6 + 1] ELSE {_MARKS}[doc_id % 6 + 1] END AS section
  FROM t, range(0, 5) AS k(i)),
s AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY i) AS body FROM l WHERE line <> '' GROUP BY doc_id, section) SELECT doc_id, section, md5(body)
  AS body_md5, length(body)::INT AS length FROM s""",
    "sector_list_dedup": f"WITH {_LINKS} SELECT sector_name, sector_code FROM links",
    "sector_dim": f"WITH {_docs_sql()}, {_LINKS}, pool AS ({_POOL_ROWS}) SELECT analysis_date, sector, sector_code, stock_code FROM pool LEFT JOIN links ON sector_name = sector",
    "mainlines": f"""WITH {_docs_sql()} SELECT analysis_date, updated_at, CASE WHEN k % 6 = 5 THEN '' ELSE array_to_string([{", ".join(_sector_sql(i) for i in range(4))}, CASE WHEN k % 5 = 4 THEN '别的' ELSE {_sector_sql(4)} END], ',') END AS names, k % 6 <> 5 AND k % 5 <> 4 AS valid FROM docs""",
    "mainline_reasons": f"WITH {_docs_sql()} {_REASONS}",
    "digest_lines": f"""WITH {_docs_sql()}, l AS (SELECT analysis_date, updated_at, trim(unnest(string_split(analysis_text, chr(10)))) AS line, generate_subscripts(string_split(analysis_text,
  chr(10)), 1) AS i FROM docs WHERE k % 6 <> 5)
SELECT analysis_date, updated_at, md5(string_agg(CASE WHEN starts_with(line, '第') THEN '**' || line || '**' ELSE '> ' || line END, chr(10) || chr(10) ORDER
  BY i)) AS digest_md5 FROM l WHERE starts_with(line, '第') OR starts_with(line, '理由：') GROUP BY 1, 2
UNION ALL SELECT analysis_date, updated_at, md5(substr(analysis_text, 1, 2000)) FROM docs WHERE k % 6 = 5""",
    "market_doc_latest": f"WITH {_docs_sql()} SELECT analysis_date, trade_date, updated_at FROM docs ORDER BY analysis_date DESC, updated_at DESC LIMIT 1",
    "market_docs_recent": f"WITH {_docs_sql()} SELECT analysis_date, trade_date, updated_at FROM docs ORDER BY analysis_date DESC, updated_at DESC LIMIT 7",
    "market_doc_by_date": f"WITH {_docs_sql()} SELECT analysis_date, arg_max(trade_date, updated_at) AS trade_date, max(updated_at) AS updated_at FROM docs GROUP BY analysis_date",
    "doc_fallback": f"""WITH {_docs_sql()}, q AS (SELECT DISTINCT (ts::DATE + 3)::DATE AS day FROM events),
r AS (SELECT day, analysis_date, trade_date, updated_at, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN trade_date = day THEN 0 WHEN analysis_date
  = day THEN 1 ELSE 2 END, CASE WHEN trade_date = day OR analysis_date = day THEN NULL ELSE analysis_date END DESC NULLS LAST, updated_at DESC) AS place
  FROM q, docs)
SELECT day, analysis_date, trade_date, updated_at FROM r WHERE place = 1""",
    "morning_panel": f"""WITH {_docs_sql()}, r AS ({_REASONS}), m AS ({" UNION ALL ".join(f"SELECT DISTINCT analysis_date, k, {i + 1} AS rank, {_sector_sql(i)} AS sector_name FROM docs" for i in range(5))})
SELECT m.analysis_date, m.rank, m.sector_name, coalesce(max(r.reason), '') AS reason FROM m LEFT JOIN r ON r.analysis_date = m.analysis_date AND r.sector_name = m.sector_name GROUP BY ALL""",
    "pool_positions": f"WITH {_docs_sql()}, pool AS ({_POOL_ROWS}) SELECT analysis_date, sector, sector_rank, stock_rank, stock_code, stock_name FROM pool WHERE updated_at % 10 = 0",
    "index_panel": f"""WITH {_INDICES}, one AS (SELECT *, {_FOUND_INDEX} AS pref FROM ix WHERE code <> '000300' QUALIFY row_number() OVER (PARTITION BY day, code ORDER BY CASE
  WHEN {_FOUND_INDEX} < 6 THEN -pos ELSE pos END) = 1)
SELECT day, (row_number() OVER (PARTITION BY day ORDER BY pref, pos))::INT AS place, code AS index_code, {_INDEX_NAMES} AS index_name, latest FROM one QUALIFY place <= 5""",
    "panel_bars": f"""WITH {BARS}, t AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS stock_code, e AS kline_trade_date_end FROM supplier, (VALUES (DATE '1996-02-10'), (DATE '1998-06-15'),
  (DATE '2005-01-01')) AS k(e)),
l AS (SELECT stock_code, kline_trade_date_end, trade_date, close, row_number() OVER (PARTITION BY stock_code, kline_trade_date_end ORDER BY trade_date
  DESC) AS place FROM t JOIN bars_supp ON symbol = stock_code AND trade_date <= kline_trade_date_end QUALIFY place <= 30),
g AS (SELECT stock_code, kline_trade_date_end, count(*) AS n, min(trade_date) AS d0, max(trade_date) AS d1, arg_max(close, trade_date) AS c1 FROM l GROUP BY 1, 2)
SELECT stock_code, kline_trade_date_end, CASE WHEN n >= 30 THEN 30 ELSE 1 END AS n, CASE WHEN n >= 30 THEN d0 ELSE DATE '1990-01-01' END AS first_date,
  coalesce(d1, DATE '1990-01-01') AS last_date, coalesce(c1, 1) AS close FROM t LEFT JOIN g USING (stock_code, kline_trade_date_end)""",
    "panel_rows": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS open_price, CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-05'
  ELSE '2024-01-06' END AS trade_date, true AS no_ratio, CASE WHEN o_orderkey % 4 < 2 THEN '2024-03-01 09:30:00' WHEN o_orderkey % 4 = 2 THEN 'soon' END
  AS analysis_time FROM orders""",
    "trial_summary": """WITH t AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 9 <> 4 THEN o_orderkey % 7 ELSE 0 END AS p, o_orderkey % 700 AS r, (o_orderkey
  % 64) / 4::DOUBLE AS c, o_orderkey AS k FROM orders)
SELECT o_orderpriority, o_orderstatus, count(*) AS samples, round(avg(p), 2) AS avg_success_pages, median(p)::DOUBLE AS median_success_pages, min(p)::INT
  AS min_success_pages, max(p)::INT AS max_success_pages, round(avg(r), 2) AS avg_total_rows, round(avg(c), 2) AS avg_total_cost_seconds,
  count(*) FILTER (k % 6 = 0) AS warmup_failures, count(*) FILTER (p = 0) AS zero_page_failures, count(*) FILTER (k % 5 = 0) AS expired_count FROM t GROUP BY 1, 2""",
    "feeds_union": f"WITH {NEWS} SELECT event_id, publish_ts, source, title FROM news",
}

_CLOCK = "strftime(to_timestamp(ts) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR, '%H:%M:%S')"
ORACLES["land_feeds"] = f"""
WITH flash AS (SELECT title, content, CASE WHEN s > {ASOF} + 300 THEN s - 86400 ELSE s END AS ts FROM (
  SELECT title, content, {ASOF - 28800} + clock[1:2]::INT * 3600 + clock[4:5]::INT * 60 + coalesce(nullif(clock[7:8], '')::INT, 0) AS s FROM ({ORACLES["flash_lines"]}))),
feed AS (SELECT event_id::BIGINT AS n, title, content, ts FROM ({ORACLES["jin10_clean"]}) JOIN ({ORACLES["jin10_title"]}) USING (event_id) JOIN ({ORACLES["jin10_ts"]}) USING (event_id)
  WHERE ts IS NOT NULL AND content <> '')
SELECT event_id, publish_ts, publish_time, subjects, title, md5(content) AS content_md5, source FROM ({ORACLES["land_news_json"]})
UNION ALL SELECT CASE WHEN n % 3 = 0 THEN md5('https://flash.test/detail/' || n) ELSE md5(ts || '+' || content || '+jin10') END, ts, {_CLOCK}, '', title, md5(content), 'jin10' FROM feed
UNION ALL SELECT md5(ts || '+' || title || '+' || content || '+10jqka'), ts, {_CLOCK}, '', title, md5(content), '10jqka' FROM flash
"""
