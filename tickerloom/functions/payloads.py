"""Landed payloads of news feeds, quote vendors and pages, parsed into rows.

Inputs are raw tables as they land: JSON bodies, page texts by lines, vendor rows and comma-separated histories. White
space is Unicode white space, written (?U)\\s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.landing import ZONE, clock_text, clock_to_epoch, epoch_seconds, event_id, split_title
from tickerloom.functions.newstext import WHITE, bound, one_of, strip

# Words that stand between a flash's time and its title, and navigation words of the flash pages.
SKIP_WORDS = ("A股", "重要", "公告", "期货", "异动", "港股", "美股", "全部", "快讯", "7*24", "7×24", "7x24", "全球财经直播", "滚动快讯")
# Marker lines of a morning text and the sections they open.
SECTIONS = {
    "【隔夜海外行情动态】": "overseas",
    "【昨日国内行情回顾】": "domestic",
    "【重大新闻汇总】": "major_news",
    "【公司公告】": "company_announcements",
    "【券商观点】": "broker_views",
    "【今日重点关注的财经数据与事件】": "calendar",
}
# Patterns that the second feed's pages leave in a story.
PAGE_NOISE = (r"首页\s*快讯详情", r"JIN10\.COM\s*I\s*一个交易工具", r"分享[:：]?\s*微信扫码分享", r"分享\s*收藏\s*详情\s*复制")
_BUTTONS = r"分享|收藏|详情|复制|微信扫码分享"
_STAMP = r"\d{4}-\d{2}-\d{2}\s+周.\s+\d{2}:\d{2}:\d{2}"
# Five indices in order of display, by code.
INDICES = {"000001": "上证指数", "399001": "深证成指", "399006": "创业板指", "000688": "科创50", "899050": "北证50"}
# The quote vendor's field names.
QUOTE_FIELDS = {
    "f17": "open_price",
    "f2": "close_price",
    "f15": "high_price",
    "f16": "low_price",
    "f18": "prev_close_price",
    "f3": "change_percent",
    "f4": "change_amount",
    "f22": "speed_percent",
    "f8": "turnover_percent",
    "f10": "volume_ratio",
    "f7": "amplitude_percent",
    "f6": "turnover_amount_yuan",
    "f21": "float_market_cap_yuan",
    "f20": "total_market_cap_yuan",
    "f9": "pe_ratio",
}

_ITEM = "STRUCT<id: STRING, event_id: STRING, title: STRING, content: STRING, ctime: STRING, time: STRING, created_at: STRING, publish_ts: STRING, subjects: ARRAY<STRUCT<subject_name: STRING>>>"


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def subjects_distinct(subjects: Column) -> Column:
    """Trimmed names of a list of subjects, empty ones dropped, each where it stands first."""
    names = F.transform(F.coalesce(subjects, F.array().cast("array<struct<subject_name:string>>")), lambda s: strip(s["subject_name"]))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def news_items(raw: DataFrame, body: str = "body") -> DataFrame:
    """News rows of landed JSON bodies: their items at data.roll_data, data.data, data.list or data, whichever is a list."""
    inside = F.from_json(body, f"STRUCT<data: STRUCT<roll_data: ARRAY<{_ITEM}>, data: ARRAY<{_ITEM}>, list: ARRAY<{_ITEM}>>>")["data"]
    bare = F.from_json(body, f"STRUCT<data: ARRAY<{_ITEM}>>")["data"]
    listed = bound(inside, lambda i: F.coalesce(i["roll_data"], i["data"], i["list"], bare))
    # An outer explode, as the filter inferred for an inner one would parse again; without an item there is no time either.
    items = raw.select(F.explode_outer(listed).alias("item")).select("item.*")
    stamp = F.coalesce(*[_given(F.nullif(F.col(c), F.lit("0"))) for c in ("ctime", "time", "created_at", "publish_ts")])
    title, content = split_title(F.col("title"), F.col("content"))
    rows = items.select(F.coalesce(_given(F.col("event_id")), _given(F.col("id"))).alias("given"), title.alias("title"), content.alias("content"), epoch_seconds(stamp).alias("publish_ts"), subjects_distinct(F.col("subjects")).alias("subjects"))
    made = event_id(F.col("given"), F.col("publish_ts"), F.col("title"), F.col("content"), F.lit("cls"))
    return rows.where(F.col("publish_ts").isNotNull()).select(made.alias("event_id"), "publish_ts", clock_text(F.col("publish_ts")).alias("publish_time"), "subjects", "title", "content", F.lit("cls").alias("source"))


#: Runs of white space but single spaces.
_SPACES = f"{one_of(WHITE.replace(' ', ''))}{one_of(WHITE)}*| {one_of(WHITE)}+"


def _clean_line(text: Column) -> Column:
    return strip(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), _SPACES, " "))


def flash_items(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """key, pos, clock, title and content of the flashes on text pages: a time's line, then after words of navigation a
    title and a content, neither being a time. Equal flashes of a page count once, the first.

    One window over a page's lines read backwards; nothing is collected.
    """
    # Lines are cleaned before they are rows: a filter on a column of rows would clean them again.
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _clean_line)
    lines = pages.select(key, F.posexplode_outer(clean).alias("pos", "line")).where("line <> ''")
    back = Window.partitionBy(key).orderBy(F.col("pos").desc())
    is_time = lambda c: (F.octet_length(c) <= 8) & c.rlike(r"^\d{2}:\d{2}(?::\d{2})?$")
    rows = lines.withColumn("story", F.when(~F.col("line").isin(*SKIP_WORDS), F.struct(strip(F.ltrim(F.col("line"), F.lit("#"))).alias("title"), F.lag("line").over(back).alias("content"))))
    rows = rows.withColumn("next", F.last("story", True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    found = rows.where(is_time(F.col("line")) & F.col("next.content").isNotNull()).select(key, "pos", F.col("line").alias("clock"), "next.title", "next.content")
    found = found.where((F.col("title") != "") & ~is_time(F.col("title")) & ~is_time(F.col("content")))
    return found.groupBy(key, "clock", "title", "content").agg(F.min("pos").alias("pos"))


# A bracketed beginning, a title before a dateline, and what goes from a story's ends, in order.
BRACKETED = r"^[【\[]\s*([^】\]]+?)\s*[】\]]"
DATELINE = r"^(.{4,80}?)\s+金十数据\d{1,2}月\d{1,2}日讯"
FEED_AFFIXES = (BRACKETED + r"\s*", DATELINE + r"[，,:：]?\s*", r"^金十数据[，,:：]?\s*", r"\s*[-—]\s*金十数据\s*$", r"\s*金十数据\s*$")


def feed_title(summary: Column, content: Column) -> Column:
    """A story's title: bracketed at its beginning, before the feed's dateline, or a short clean summary; else empty."""
    s, c = strip(summary), strip(content)
    inner = _given(strip(F.regexp_extract(c, "(?U)" + BRACKETED, 1)))
    before = _given(strip(F.regexp_extract(c, "(?U)" + DATELINE, 1)))
    short = (s != "") & ~s.rlike(_BUTTONS) & ~s.rlike(r"\d{4}-\d{2}-\d{2}") & (F.length(s) <= 80)
    return F.coalesce(F.when(inner != "金十数据", inner), F.when(~before.rlike(_BUTTONS), before), F.when(short, s), F.lit(""))


def feed_content(content: Column, summary: Column) -> Column:
    """A story without the page's words, what is appended after a second dateline, its title and the feed's name."""
    text = strip(content)
    for pattern in PAGE_NOISE:
        text = F.regexp_replace(text, "(?U)" + pattern, " ")
    text = strip(F.regexp_replace(text, rf"(?Us)\s*[-—]\s*金十数据\s+{_STAMP}\s+.*$", ""))
    for pattern in FEED_AFFIXES:
        text = F.regexp_replace(text, "(?U)" + pattern, "")
    return F.when(strip(content) == "", strip(summary)).otherwise(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def feed_epoch(stamp: Column, clock: Column, now: int) -> Column:
    """The epoch of a dated local stamp in stamp, else of a local HH:MM:SS on now's day, else null."""
    day, at = (F.regexp_extract(F.coalesce(stamp, F.lit("")), rf"(?U)(\d{{4}}-\d{{2}}-\d{{2}})\s+周.\s+(\d{{2}}:\d{{2}}:\d{{2}})", g) for g in (1, 2))
    today = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(F.lit(now)), ZONE), "yyyy-MM-dd")
    local = F.coalesce(F.try_to_timestamp(F.concat_ws(" ", day, at), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.concat_ws(" ", today, clock), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.unix_seconds(F.to_utc_timestamp(local, ZONE))


def _landed(source: str, given: Column, ts: Column, title: Column, content: Column, *parts: Column) -> list[Column]:
    """A news row's columns; its id is the given one, else the digest of parts."""
    none = F.array().cast("array<string>")
    return [event_id(given, *parts).alias("event_id"), ts.alias("publish_ts"), clock_text(ts).alias("publish_time"), none.alias("subjects"), title.alias("title"), content.alias("content"), F.lit(source).alias("source")]


def flash_news(flashes: DataFrame, now: int) -> DataFrame:
    """News rows of flash_items as of now: their clocks become epochs of the last day, a missing content is the title."""
    rows = flashes.withColumn("ts", clock_to_epoch(F.col("clock"), now))
    told = F.coalesce(_given(strip(F.col("content"))), strip(F.col("title")))
    rows = rows.select("ts", strip(F.col("title")).alias("title"), told.alias("content")).where(F.col("ts").isNotNull() & (F.col("content") != ""))
    name = F.lit("10jqka")
    return rows.select(*_landed("10jqka", F.lit(None).cast("string"), F.col("ts"), F.col("title"), F.col("content"), F.col("ts"), F.col("title"), F.col("content"), name))


def feed_news(stories: DataFrame, now: int) -> DataFrame:
    """News rows of the second feed's stories (content, summary, stamp, clock, detail_url) as of now.

    A story is known by its page's address, else by its time and content; without a time or content it is dropped.
    """
    told, named = feed_content(F.col("content"), F.col("summary")), feed_title(F.col("summary"), F.col("content"))
    rows = stories.select("detail_url", named.alias("title"), told.alias("content"), feed_epoch(F.col("stamp"), F.col("clock"), now).alias("ts"))
    rows = rows.where(F.col("ts").isNotNull() & (F.col("content") != ""))
    page = F.when(F.coalesce("detail_url", F.lit("")) != "", F.md5("detail_url"))
    return rows.select(*_landed("jin10", page, F.col("ts"), F.col("title"), F.col("content"), F.col("ts"), F.col("content"), F.lit("jin10")))


def vendor_number(text: Column) -> Column:
    """A number, null for the vendor's marks of nothing and for what is none."""
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n), n)


def quote_rows(raw: DataFrame) -> DataFrame:
    """symbol, name, the numbers of QUOTE_FIELDS and float_shares of vendor rows that have a code and a name."""
    rows = raw.where((F.coalesce("f12", F.lit("")) != "") & (F.coalesce("f14", F.lit("")) != ""))
    rows = rows.select(F.col("f12").alias("symbol"), F.col("f14").alias("name"), *[vendor_number(F.col(f)).alias(c) for f, c in QUOTE_FIELDS.items()])
    return rows.withColumn("float_shares", F.try_divide("float_market_cap_yuan", F.nullif("close_price", F.lit(0.0))))


def history_rows(raw: DataFrame) -> DataFrame:
    """Bars of vendor histories: symbol, name, lines (each eleven values or more between commas, in order of time)."""
    rows = raw.select("symbol", "name", F.posexplode("lines").alias("pos", "line")).withColumn("v", F.split("line", ",")).where(F.size("v") >= 11)
    names = {1: "open_price", 2: "close_price", 3: "high_price", 4: "low_price", 6: "turnover_amount_yuan", 7: "amplitude_percent", 8: "change_percent", 9: "change_amount", 10: "turnover_percent"}
    bars = rows.select("symbol", "name", "pos", F.col("v")[0].try_cast("date").alias("trade_date"), *[vendor_number(F.col("v")[i]).alias(c) for i, c in names.items()])
    return bars.withColumn("prev_close_price", F.lag("close_price").over(Window.partitionBy("symbol").orderBy("pos"))).drop("pos")


def index_rows(raw: DataFrame) -> DataFrame:
    """The five indices in order, from vendor rows by code padded to six digits; an index that is not there has no numbers
    and missing set, which callers turn into an error."""
    numbers = {"f2": "latest", "f3": "pct_change", "f4": "change", "f15": "high", "f16": "low", "f17": "open", "f18": "prev_close"}
    rows = raw.withColumn("index_code", F.lpad(F.trim("f12"), 6, "0")).where(F.col("index_code").isin(*INDICES))
    per = rows.groupBy("index_code").agg(*[F.max(vendor_number(F.col(f))).alias(c) for f, c in numbers.items()], F.lit(False).alias("there"))
    wanted = raw.sparkSession.createDataFrame([(i + 1, c, n) for i, (c, n) in enumerate(INDICES.items())], "place int, index_code string, index_name string")
    return wanted.join(F.broadcast(per), "index_code", "left").withColumn("missing", F.col("there").isNull()).drop("there").orderBy("place")


def index_snapshot(raw: DataFrame) -> DataFrame:
    """index_rows without missing ones: the task that meets an index without a row fails, naming it."""
    absent = F.raise_error(F.concat(F.lit("no quote of index "), F.col("index_code")))
    return index_rows(raw).withColumn("index_code", F.when(F.col("missing"), absent.cast("string")).otherwise(F.col("index_code"))).drop("missing")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section and body: a text's lines under the marker line before them, head before the first marker.

    A marker is found anywhere in a line, and its line goes. Lines are ordered and joined per section of one text.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    marker = F.coalesce(*[F.when(F.contains("line", F.lit(m)), F.lit(s)) for m, s in SECTIONS.items()])
    order = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("marker", marker).withColumn("section", F.coalesce(F.last("marker", True).over(order), F.lit("head"))).where("marker IS NULL")
    return rows.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))


def sector_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct (sector_name, sector_code) of the links to sector pages, in order of code."""
    pattern = r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*/thshy/detail/code/\d{6}[^\"']*)[\"'][^>]*>(.*?)</a>"
    links = pages.select(F.explode(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("href"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("shown"))).alias("l"))
    name = strip(F.regexp_replace("l.shown", r"<[^>]*>", ""))
    found = links.select(name.alias("sector_name"), F.regexp_extract("l.href", r"/thshy/detail/code/(\d{6})", 1).alias("sector_code")).where("sector_name <> ''")
    return found.distinct().orderBy("sector_code", "sector_name")


def with_sector_codes(rows: DataFrame, dimension: DataFrame, by: str = "sector") -> DataFrame:
    """rows with the sector_code of their sector; dimension has a row per sector (sector_links())."""
    known = dimension.groupBy(F.col("sector_name").alias(by)).agg(F.min("sector_code").alias("sector_code"))
    return rows.join(known, by, "left")
