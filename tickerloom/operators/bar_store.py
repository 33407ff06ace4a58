"""Bars laid out so that work by symbol needs no exchange: a folder per month, rows dealt to buckets by symbol and sorted.

Windows and groupings by symbol, and joins by it with tables of as many buckets, read their buckets where they lie; dates
prune months. A month is written again as a whole, by append for a new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Choose it so that a bucket's rows of all months fit a task: the number stays with the table.
BUCKETS = 8


def store_bars(bars: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes bars (symbol, trade_date, ...) as the table name at path; appends if the table is there."""
    rows = bars.withColumn("month", F.trunc("trade_date", "month"))
    # Dealt as the buckets are, so that a task writes one bucket: a file per month and bucket.
    dealt = rows.repartition(buckets, "symbol")
    dealt.write.mode("append").partitionBy("month").bucketBy(buckets, "symbol").sortBy("symbol", "trade_date").option("path", path).saveAsTable(name)


def stored_bars(spark: SparkSession, name: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The bars of a table, of the days from first to last; other months' folders are not read."""
    rows = spark.table(name)
    if first:
        rows = rows.where((F.col("month") >= F.trunc(F.lit(first).cast("date"), "month")) & (F.col("trade_date") >= F.lit(first).cast("date")))
    if last:
        rows = rows.where((F.col("month") <= F.trunc(F.lit(last).cast("date"), "month")) & (F.col("trade_date") <= F.lit(last).cast("date")))
    return rows.drop("month")


def stored_months(spark: SparkSession, name: str) -> list[str]:
    """The months that have bars, by the folders alone."""
    return sorted(r[0].removeprefix("month=") for r in spark.sql(f"SHOW PARTITIONS {name}").collect())
