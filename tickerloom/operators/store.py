"""Keyed merges of stored tables. Frames go in and out here; sources.versioned writes them as versions."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.rejects import Routed, bar_rules, routed

if TYPE_CHECKING:
    from tickerloom.sources.versioned import VersionedTable

#: The three stored tables: what their rows are known by and partitioned by, and what stays as first stored.
NEWS_TABLE = {"keys": ["event_id"], "partition": "to_date(from_utc_timestamp(timestamp_seconds(publish_ts), 'Asia/Shanghai'))", "moves": True}
BARS_TABLE = {"keys": ["trade_date", "symbol"], "partition": "trade_date", "keep": ("id", "created_at")}
DOCS_TABLE = {"keys": ["biz_date"], "partition": "biz_date", "keep": ("created_at",)}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows over it by keys; columns in keep stay as they were where the key was stored before.

    new has one row per key. A full outer join: both sides are shuffled by key once.
    """
    o = old.alias("o")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    there = F.col("n.__new")
    joined = o.join(new.withColumn("__new", F.lit(True)).alias("n"), on, "full_outer")

    def value(c: str):
        if c in keys or c in keep:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        return F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def upsert_news(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored news with new rows over it by event_id, whole rows at a time; of a repeated id in new the newest counts."""
    return upsert(old, newest(new, ["event_id"], "publish_ts"), ["event_id"])


def newest(rows: DataFrame, keys: list[str], by: str, earliest: bool = False) -> DataFrame:
    """Of rows with equal keys the one greatest (or least) in by; rows are pre-aggregated, so a hot key costs a row per task."""
    others = [c for c in rows.columns if c not in keys]
    pick = F.min_by if earliest else F.max_by
    best = rows.groupBy(*keys).agg(pick(F.struct(*others), F.struct(by, F.xxhash64(*others))).alias("__row"))
    return best.select(*keys, "__row.*").select(rows.columns)


def upsert_daily(old: DataFrame, new: DataFrame, key: str = "biz_date", text_key: bool = False) -> DataFrame:
    """Documents of a day, one per key: created_at stays as it was first, everything else is the new document's.

    A null key is an error, as is a blank one where the key is text: the task that meets it fails.
    """
    missing = F.col(key).isNull() | (F.trim(key) == "") if text_key else F.col(key).isNull()
    checked = new.withColumn(key, F.when(missing, F.raise_error(F.lit(f"{key} must not be blank")).cast(new.schema[key].dataType)).otherwise(F.col(key)))
    return upsert(old, checked, [key], keep=("created_at",))


def record_outcomes(old: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Result rows by (trade_date, stock_code) with the outcomes of a run: id and created_at stay, a success clears the error."""
    error = F.when(F.col("analysis_status") != "succeeded", F.col("error_message"))
    at = F.lit(now).cast("timestamp")
    new = outcomes.withColumns({"error_message": error, "updated_at": at, "created_at": at})
    return upsert(old, new.select(old.columns), ["trade_date", "stock_code"], keep=("id", "created_at"))


def merge_bars(table: VersionedTable, rows: DataFrame) -> Routed:
    """Lays the valid ones of rows over the stored bars; the others are returned with their reasons."""
    parts = routed(rows, "upsert_bars", bar_rules(), ["symbol", "trade_date"])
    table.merge(parts.passed)
    return parts
