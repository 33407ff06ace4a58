"""Search, listing and counting of stored news, and of dated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.newstext import sentiment, strip

ZONE = "Asia/Shanghai"


def local_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), ZONE))


def filtered(news: DataFrame, trade_date: str | None = None, sector: str | None = None, source: str | None = None, keyword: str | None = None, min_score: int | None = None) -> DataFrame:
    """News that meets every filter given. A day is a local day; its bounds are epochs, so that the scan can skip by them.

    keyword is a regular expression, as it was given, matched in any case of letters.
    """
    if trade_date:
        day = F.lit(trade_date).cast("date").cast("timestamp")
        start = F.unix_seconds(F.to_utc_timestamp(day, ZONE))
        news = news.where((F.col("publish_ts") >= start) & (F.col("publish_ts") < start + 86400))
    if sector:
        news = news.where(F.array_contains("sectors", sector))
    if source:
        news = news.where(F.col("source") == source)
    if keyword:
        news = news.where(F.col("title").rlike(f"(?iu){keyword}") | F.col("content").rlike(f"(?iu){keyword}"))
    if min_score is not None:
        news = news.where(F.col("score") >= min_score)
    return news


def page(news: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    return news.orderBy(F.col("publish_ts").desc(), "event_id").offset(max(skip, 0)).limit(max(limit, 1))


def recent(news: DataFrame, now: int, days: int) -> DataFrame:
    """A flat view of the last days (1 to 30), newest first, with a sentiment label and a local time text."""
    days = min(max(days, 1), 30)
    rows = news.where(F.col("publish_ts").between(now - days * 86400, now))
    shown = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("publish_ts"), ZONE), "yyyy-MM-dd HH:mm:ss")
    given = F.nullif(strip(F.col("publish_time")), F.lit("")) if "publish_time" in news.columns else F.lit(None).cast("string")
    return rows.select("event_id", "publish_ts", F.coalesce(given, shown).alias("publish_time"), "title", "source", "score", sentiment(F.col("score")).alias("sentiment"))


def hours_back(news: DataFrame, now: int, hours: int, limit: int = 50) -> DataFrame:
    hours = min(max(hours, 1), 24)
    return page(news.where(F.col("publish_ts").between(now - hours * 3600, now)), limit=limit)


def top_items(news: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The commonest entries of a list column."""
    counts = news.select(F.explode(column).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "item").limit(limit)


def totals(news: DataFrame, now: int) -> DataFrame:
    today = local_date(F.lit(now))
    return news.agg(F.count(F.lit(1)).alias("total"), F.count_if(local_date(F.col("publish_ts")) == today).alias("today"))


def sentiment_share(news: DataFrame) -> DataFrame:
    counts = news.groupBy(sentiment(F.col("score")).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def source_cursor(news: DataFrame) -> DataFrame:
    return news.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("publish_ts").alias("latest_ts"))


def new_events_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.join(stored.select("event_id"), "event_id", "left_anti")


def past_cursor(incoming: DataFrame, cursor: DataFrame) -> DataFrame:
    """Drops rows older than their source's cursor (source, newest); the equal second stays. A row per source is broadcast."""
    known = cursor.select(F.col("source").alias("of"), "newest")
    joined = incoming.join(F.broadcast(known), F.col("source") == F.col("of"), "left")
    return joined.where(F.col("newest").isNull() | (F.col("publish_ts") >= F.col("newest"))).drop("of", "newest")


def after_cursor(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Drops rows older than the newest stored of their source."""
    return past_cursor(incoming, stored.groupBy("source").agg(F.max("publish_ts").alias("newest")))


def feeds_union(feeds: list[DataFrame]) -> DataFrame:
    """Rows of several feeds in order of time; equal times keep the order of feeds."""
    out = None
    for i, feed in enumerate(feeds):
        rows = feed.withColumn("__feed", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.orderBy("publish_ts", "__feed", "event_id").drop("__feed")
