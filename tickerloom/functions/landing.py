"""Column functions that bring landed payloads into the engine's shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.newstext import fixed, strip

ZONE = "Asia/Shanghai"
_LEAD = r"(?U)^\s*(?:【([^】]*)】|\[([^\]]*)\]|〖([^〗]*)〗)\s*"


def split_title(title: Column, content: Column) -> tuple[Column, Column]:
    """title and content: a bracketed beginning of content is the title where none is given, and never stays in content."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(content, F.lit("")), _LEAD, g), F.lit("")) for g in (1, 2, 3)])
    own = F.nullif(strip(title), F.lit(""))
    return F.coalesce(own, strip(found), F.lit("")), strip(F.regexp_replace(F.coalesce(content, F.lit("")), _LEAD, ""))


def epoch_seconds(value: Column) -> Column:
    """Seconds of an epoch given in seconds or milliseconds; null for what is no number."""
    n = value.cast("string").try_cast("bigint")
    return F.when(n > 1_000_000_000_000, F.floor(n / 1000)).otherwise(n)


def clock_text(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(ts), ZONE), "HH:mm:ss")


def event_id(given: Column, *parts: Column) -> Column:
    """The given id, else the digest of the parts joined by +."""
    return F.coalesce(F.nullif(strip(given), F.lit("")), F.md5(F.concat_ws("+", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def clock_to_epoch(clock: Column, now: int) -> Column:
    """The epoch of a local HH:MM[:SS] on now's day, a day earlier if that lies more than five minutes ahead."""
    local = F.from_utc_timestamp(F.timestamp_seconds(F.lit(now)), ZONE)
    parts = [F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", g) for g in (1, 2, 3)]
    seconds = parts[0].try_cast("int") * 3600 + parts[1].try_cast("int") * 60 + F.coalesce(F.nullif(parts[2], F.lit("")).try_cast("int"), F.lit(0))
    start = F.unix_seconds(F.to_utc_timestamp(F.date_trunc("day", local), ZONE))
    at = start + seconds
    return F.when(at > now + 300, at - 86400).otherwise(at)


def market_prefix(symbol: Column) -> Column:
    """1 or 0 by a six-digit symbol's first digit; null for what is no symbol."""
    first = F.substring(symbol, 1, 1)
    return F.when(symbol.rlike(r"^\d{6}$"), F.when(first.isin("5", "6", "9"), 1).when(first.isin("0", "1", "2", "3", "4", "8"), 0))


def codes_in_text(text: Column, most: int = 100) -> Column:
    """Distinct six-digit codes in order of appearance, the first most of them."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\d{6}\b"), 0)), 1, most)


def hundred_millions(value: Column) -> Column:
    return F.concat(fixed(value / 1e8, 2), F.lit("亿"))


def hundred_million_shares(value: Column) -> Column:
    return F.concat(hundred_millions(value), F.lit("股"))


def fallback_trade_date(ts: Column) -> Column:
    """The weekday a local time belongs to: weekends fall back to Friday, before nine o'clock to the weekday before."""
    local = F.from_utc_timestamp(F.timestamp_seconds(ts), ZONE)
    day, early = F.to_date(local), F.hour(local) < 9
    weekday = F.weekday(day)
    back = F.when(weekday == 5, 1).when(weekday == 6, 2).when(early & (weekday == 0), 3).when(early, 1).otherwise(0)
    return F.date_sub(day, back)


def batch_clean(rows: DataFrame, arrival: str, most: int | None = None) -> DataFrame:
    """Rows with content, of each event_id the first by arrival, newest first, at most so many."""
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(arrival))
    out = rows.where((F.coalesce("content", F.lit("")) != "") & F.col("publish_ts").isNotNull()).withColumn("place", place).where("place = 1").drop("place")
    out = out.orderBy(F.col("publish_ts").desc(), arrival)
    return out.limit(most) if most else out


# Lines with these are scripts, not text.
SCRIPTS = ("window.location.href", "document.domain")


def unique_lines(text: Column) -> Column:
    """Squeezed lines of text, empty ones and scripts dropped, each kept where it stands first."""
    lines = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_distinct(F.filter(lines, lambda x: (x != "") & ~x.contains(SCRIPTS[0]) & ~x.contains(SCRIPTS[1])))
