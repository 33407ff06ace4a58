"""Pages far down a listing, newest first, without gathering what is skipped.

Counts come first: rows per range of time, from days down to seconds, and within one second by the beginnings of the event
ids, until the rows from the page's range on are at most SMALL. Only the ranges that hold the page are then sorted.
Every count is one row per range on the driver, and reads the columns it counts by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be sorted in one place, and widths of ranges in seconds.
SMALL = 10_000
STEPS = (86400 * 64, 86400, 3600, 60, 1)
#: Distinct beginnings of ids are counted up to this length.
LONGEST = 64


def _ranges(counts: list[tuple], skip: int, limit: int) -> tuple[list, int]:
    """Of (range, rows) in order of the listing those that hold rows skip to skip + limit, and how many rows precede them."""
    before, first, chosen = 0, 0, []
    for key, n in counts:
        if before + n > skip and before < skip + limit:
            if not chosen:
                first = before
            chosen.append((key, n))
        before += n
    return chosen, first


def deep_page(news: DataFrame, skip: int = 0, limit: int = 50, small: int = SMALL) -> DataFrame:
    """The rows that page() gives: by publish_ts, newest first and null last, then event_id; skip and limit have the same floors.

    The rows that meet in one task are those of the page's own ranges, at most small besides the page itself.
    """
    skip, limit = max(skip, 0), max(limit, 1)
    rows = news
    for step in STEPS:
        key = F.floor(F.col("publish_ts") / step).cast("bigint")
        counts = [(r["key"], r["n"]) for r in rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per range
        counts.sort(key=lambda c: (c[0] is None, -(c[0] or 0)))
        chosen, before = _ranges(counts, skip, limit)
        if not chosen:
            return rows.limit(0)
        skip -= before
        rows = _within(rows, [k for k, _ in chosen], step)
        if sum(n for _, n in chosen) <= small + limit:
            break
    else:
        rows, skip = _by_ids(rows, skip, limit, small)
    return rows.orderBy(F.col("publish_ts").desc(), "event_id").offset(skip).limit(limit)


def _within(rows: DataFrame, keys: list[int | None], step: int) -> DataFrame:
    """Rows of neighbouring ranges; bounds on publish_ts itself, so that the scan skips by them."""
    ts = F.col("publish_ts")
    known = [k for k in keys if k is not None]
    inside = ts.between(min(known) * step, (max(known) + 1) * step - 1) if known else F.lit(False)
    return rows.where(inside | ts.isNull()) if None in keys else rows.where(inside)


def _by_ids(rows: DataFrame, skip: int, limit: int, small: int) -> tuple[DataFrame, int]:
    """Rows of a few seconds cut down by (second, beginning of the id), a letter more each time."""
    length = 0
    while length < LONGEST:
        length += 1
        start = F.substring("event_id", 1, length)
        counted = rows.groupBy("publish_ts", start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
        counts = [((r["publish_ts"], r["start"]), r["n"]) for r in counted.collect()]  # a row per beginning
        # As the listing sorts: null times last, null ids first, ids by their bytes.
        counts.sort(key=lambda c: (c[0][0] is None, -(c[0][0] or 0), c[0][1] is not None, (c[0][1] or "").encode()))
        chosen, before = _ranges(counts, skip, limit)
        skip -= before
        keys = F.lit(False)
        for (ts, begin), _ in chosen:
            keys = keys | (F.col("publish_ts").eqNullSafe(F.lit(ts)) & start.eqNullSafe(F.lit(begin)))
        rows = rows.where(keys)
        if sum(n for _, n in chosen) <= small + limit:
            break
    return rows, skip
