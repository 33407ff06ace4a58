"""Dated market documents and the views of a panel over them, over indices, and over analysed stocks with their bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.newstext import SECTORS, strip
from tickerloom.functions.payloads import INDICES
from tickerloom.operators.bars import MIN_BARS

# How main lines and their reasons are written in an analysis.
MAINLINE = r"(?m)^第[一二三四五]主线：[^\S\n]*(\S.*?)[^\S\n]*$"
MAINLINE_LOOSE = r"(?U)^\s*第[一二三四五六七八九十\d]+主线\s*[：:]\s*(.+?)\s*$"
REASON = r"(?U)^\s*理由\s*[：:]\s*(.*)$"
MAINLINE_STARTS = ("第一主线：", "第二主线：", "第三主线：", "第四主线：", "第五主线：")
NO_ANALYSIS = "暂无盘前主线分析结果"


def mainlines(text: Column, most: int = 5) -> Column:
    """Names of the main lines of an analysis in order, the first most."""
    return F.slice(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MAINLINE), 1), strip), 1, most)


def mainlines_valid(text: Column) -> Column:
    """Whether there are five of them and each is a known sector."""
    names = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MAINLINE), 1), strip)
    return (F.size(names) == 5) & F.forall(names, lambda n: n.isin(*SECTORS))


def mainline_reasons(docs: DataFrame, key: str, text: str = "analysis_text") -> DataFrame:
    """key, rank, sector_name and reason: what stands from a heading's reason on until the next heading.

    Headings and reasons are marked line by line and filled forward in one window over a text's lines.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    head = F.when(F.col("line").rlike(MAINLINE_LOOSE), strip(F.regexp_extract("line", MAINLINE_LOOSE, 1)))
    rows = lines.withColumn("head", head).withColumn("rank", F.count("head").over(order)).where("rank > 0")
    within = Window.partitionBy(key, "rank").orderBy("pos")
    opens = F.col("head").isNull() & F.col("line").rlike(REASON)
    rows = rows.withColumns({"opens": opens, "told": F.max(opens).over(within)})
    said = F.when(F.col("opens"), strip(F.regexp_extract("line", REASON, 1))).when(F.col("told") & F.col("head").isNull(), strip(F.col("line")))
    parts = F.array_sort(F.collect_list(F.when(said != "", F.struct("pos", said.alias("said")))))
    per = rows.groupBy(key, "rank").agg(F.max("head").alias("sector_name"), F.array_join(F.transform(parts, lambda p: p["said"]), "\n").alias("reason"))
    return per.withColumn("rank", F.col("rank").cast("int"))


def digest_lines(text: Column) -> Column:
    """Headings in bold and reasons as quotations; without any, the first 2000 characters; a fixed sentence for no text."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")
    is_head = lambda x: x.rlike("^(?:" + "|".join(MAINLINE_STARTS) + ")")
    shown = F.filter(F.transform(lines, lambda x: F.when(is_head(x), F.concat(F.lit("**"), x, F.lit("**"))).when(x.startswith("理由："), F.concat(F.lit("> "), x))), lambda x: x.isNotNull())
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_ANALYSIS)).when(F.size(shown) > 0, F.array_join(shown, "\n\n")).otherwise(F.substring(text, 1, 2000))


def docs_recent(docs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest documents by analysis_date, then updated_at; the newest one with limit 1."""
    return docs.orderBy(F.col("analysis_date").desc(), F.col("updated_at").desc()).limit(max(limit, 1))


def docs_by_date(docs: DataFrame, column: str) -> DataFrame:
    """The newest version of the document of every date in column."""
    place = F.row_number().over(Window.partitionBy(column).orderBy(F.col("updated_at").desc()))
    return docs.where(F.col(column).isNotNull()).withColumn("place", place).where("place = 1").drop("place")


def docs_for(docs: DataFrame, days: DataFrame) -> DataFrame:
    """For every day of days: the newest document whose trade_date it is, else whose analysis_date it is, else the newest of all."""
    by_trade = docs_by_date(docs, "trade_date").select(F.col("trade_date").alias("day"), F.struct(*docs.columns).alias("d1"))
    by_analysis = docs_by_date(docs, "analysis_date").select(F.col("analysis_date").alias("day"), F.struct(*docs.columns).alias("d2"))
    newest = docs_recent(docs, 1).select(F.struct(*docs.columns).alias("d3"))
    joined = days.join(by_trade, "day", "left").join(by_analysis, "day", "left").join(F.broadcast(newest), how="left")
    return joined.select("day", F.coalesce("d1", "d2", "d3").alias("doc")).select("day", "doc.*")


def morning_panel(docs: DataFrame, key: str = "analysis_date") -> DataFrame:
    """key, rank, sector_name and reason of every document's main sectors; rank falls back to the position in the list."""
    items = docs.select(key, F.posexplode("mainline_sectors").alias("pos", "m"))
    items = items.select(key, F.coalesce(F.nullif("m.rank", F.lit(0)), F.col("pos") + 1).alias("rank"), strip(F.col("m.sector_name")).alias("sector_name"))
    reasons = mainline_reasons(docs, key).groupBy(key, "sector_name").agg(F.max_by("reason", "rank").alias("reason"))
    return items.join(reasons, [key, "sector_name"], "left").select(key, "rank", "sector_name", F.coalesce("reason", F.lit("")).alias("reason"))


def pool_positions(docs: DataFrame, key: str = "analysis_date") -> DataFrame:
    """The stock pool of nested lists: blank sectors go, a stock's rank is its place in its list, blank codes keep theirs."""
    sectors = docs.select(key, F.explode("sector_top_stocks").alias("s")).select(key, strip(F.col("s.sector_name")).alias("sector"), F.col("s.rank").alias("sector_rank"), F.posexplode("s.stocks").alias("pos", "k")).where("sector <> ''")
    out = sectors.select(key, "sector", "sector_rank", (F.col("pos") + 1).alias("stock_rank"), strip(F.col("k.code")).alias("stock_code"), strip(F.col("k.name")).alias("stock_name"))
    return out.where("stock_code <> ''")


def index_panel(rows: DataFrame, by: str, order: str = "pos", most: int = 5) -> DataFrame:
    """Of every by's index rows: the preferred five in order, then others in theirs (000300 never), most in all, with place."""
    code = F.lpad(F.trim("index_code"), 6, "0")
    preferred = F.array_position(F.array(*map(F.lit, INDICES)), F.col("index_code"))
    known = F.create_map(*[F.lit(x) for pair in INDICES.items() for x in pair])
    rows = rows.withColumn("index_code", code).where("index_code <> '000300'")
    # Of a preferred code the last row counts, of another one the first.
    last = Window.partitionBy(by, "index_code").orderBy(F.when(preferred > 0, -F.col(order)).otherwise(F.col(order)))
    rows = rows.withColumn("copy", F.row_number().over(last)).where("copy = 1").withColumn("first", F.when(preferred > 0, preferred).otherwise(F.lit(len(INDICES) + 1)))
    place = F.row_number().over(Window.partitionBy(by).orderBy("first", order))
    out = rows.withColumn("place", place).where(F.col("place") <= most).drop("copy", "first")
    return out.withColumn("index_name", F.coalesce(F.try_element_at(known, F.col("index_code")), strip(F.col("index_name"))))


def panel_row(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """rows with each unified column from the first of its aliases that is there and not null, null where none is."""
    have = set(rows.columns)
    out = [F.coalesce(*[F.col(a) for a in names if a in have], F.lit(None)).alias(c) for c, names in aliases.items()]
    return rows.select(*out)


def local_time_text(text: Column, zone: str = "Asia/Shanghai") -> Column:
    """ISO text as local yyyy-MM-dd HH:mm:ss: with an offset it is converted, without one it is local already; other text
    stays, blank is null."""
    t = strip(text)
    shown = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    zoned = t.rlike(r"(?:Z|[+-]\d{2}:\d{2})$")
    at = F.regexp_replace(t, " ", "T").try_cast("timestamp")
    return F.when(t == "", None).when(at.isNull(), t).otherwise(F.when(zoned, shown(F.from_utc_timestamp(at, zone))).otherwise(shown(at)))


def panel_bars(results: DataFrame, bars: DataFrame, limit: int = MIN_BARS) -> DataFrame:
    """results (stock_code, kline_trade_date_end, input_bars) with kline, the last limit bars up to that date, and snapshot,
    the last of them; where fewer bars are stored, kline is the analysis's own input.

    A bar tells, by the next bar's date, which results end at it; those ask for the bars before it by number.
    """
    code = F.lpad(F.trim("stock_code"), 6, "0")
    asked = results.withColumn("stock_code", code)
    ends = asked.select(F.col("stock_code").alias("symbol"), F.col("kline_trade_date_end").alias("end")).distinct()
    w = Window.partitionBy("symbol").orderBy("trade_date")
    known = bars.join(ends.select("symbol").distinct(), "symbol", "left_semi").withColumns({"__at": F.row_number().over(w), "__next": F.lead("trade_date").over(w)})
    hit = known.join(ends, "symbol").where((F.col("trade_date") <= F.col("end")) & (F.col("__next").isNull() | (F.col("end") < F.col("__next"))))
    wanted = hit.select("symbol", "end", F.explode(F.sequence(F.greatest(F.col("__at") - limit + 1, F.lit(1)), F.col("__at"))).alias("__at"))
    bar = F.struct("trade_date", "open", "high", "low", "close")
    sets = known.join(wanted, ["symbol", "__at"]).groupBy("symbol", "end").agg(F.array_sort(F.collect_list(bar)).alias("stored"))  # limit bars each
    joined = asked.join(sets, (F.col("stock_code") == F.col("symbol")) & (F.col("kline_trade_date_end") == F.col("end")), "left").drop("symbol", "end")
    kline = F.when(F.size("stored") >= limit, F.col("stored")).otherwise(F.col("input_bars"))
    return joined.withColumn("kline", kline).withColumn("snapshot", F.coalesce(F.try_element_at("stored", F.lit(-1)), F.try_element_at("kline", F.lit(-1)))).drop("stored")


def trial_summary(trials: DataFrame, by: list[str]) -> DataFrame:
    """Per case: samples, mean, median, least and most successful pages, mean rows and cost, and counts of failures.

    The median is exact: percentile over a case's few samples.
    """
    pages = F.coalesce("success_pages", F.lit(0))
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg(pages), 2).alias("avg_success_pages"),
        F.median(pages).alias("median_success_pages"),
        F.min(pages).alias("min_success_pages"),
        F.max(pages).alias("max_success_pages"),
        F.round(F.avg(F.coalesce("total_rows", F.lit(0))), 2).alias("avg_total_rows"),
        F.round(F.avg(F.coalesce("total_cost_seconds", F.lit(0.0))), 2).alias("avg_total_cost_seconds"),
        F.count_if(F.contains(F.coalesce("failure_reason", F.lit("")), F.lit("warm-up 失败"))).alias("warmup_failures"),
        F.count_if(pages == 0).alias("zero_page_failures"),
        F.count_if(F.coalesce("stopped_by_expire", F.lit(False))).alias("expired_count"),
    )
