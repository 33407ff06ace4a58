"""Views of the test tables in the engine's shapes, and the same views as SQL common table expressions for oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2024-01-31 00:00 UTC: the rankings' point in time over the events table.
ASOF = 1706659200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str, only_id: int | None = None) -> DataFrame:
    """event_id, publish_ts, source, title, content, subjects, score, companies, sectors; only_id: of one event, by its own
    key, so that both scans skip what can't hold it."""
    events = table(spark, sf_dir, "events")
    if only_id is not None:
        events = events.where(F.col("event_id") == only_id)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind, user = F.col("event_type"), F.col("user_id")
    return events.join(docs, F.col("event_id") == F.col("doc_id"), "left").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("publish_ts"),
        F.element_at(F.array(F.lit("cls"), F.lit("jin10"), F.lit("10jqka")), (F.col("event_id") % 3 + 1).cast("int")).alias("source"),
        kind.alias("title"),
        F.coalesce("text", "props").alias("content"),
        F.array(kind).alias("subjects"),
        F.greatest(F.lit(-100), F.least(F.lit(100), F.floor("value").cast("int") - 50)).alias("score"),
        F.array(F.concat(F.lit("C"), user)).alias("companies"),
        F.when(user % 7 == 0, None).when(user % 5 == 0, F.array(kind, kind)).otherwise(F.array(kind, F.concat(F.lit("U"), user % 20))).alias("sectors"),
    )


NEWS = """news AS (SELECT event_id::VARCHAR AS event_id, floor(epoch(ts))::BIGINT AS publish_ts,
  CASE event_id % 3 WHEN 0 THEN 'cls' WHEN 1 THEN 'jin10' ELSE '10jqka' END AS source, event_type AS title,
  coalesce(text, props) AS content, [event_type] AS subjects,
  greatest(-100, least(100, floor(value)::INT - 50)) AS score, ['C' || user_id] AS companies,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN [event_type, event_type] ELSE [event_type, 'U' || (user_id % 20)] END AS sectors
  FROM events LEFT JOIN documents ON event_id = doc_id)"""


def bars_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per event type."""
    events = table(spark, sf_dir, "events").withColumn("trade_date", F.to_date("ts"))
    order = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("symbol"), "trade_date").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close")
    )


def bars_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of a supplier's unit prices.

    A supplier's lines, some hundreds at any size, are exchanged by symbol as they are: smaller than partial sums with two
    five-column orders, sorted once, and windows by symbol over the bars exchange nothing. Their number of parts is fixed,
    as adaptive execution would judge it by the lines, not by the sets of bars that are made of them.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), *columns).repartition(parts, "symbol")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.groupBy("symbol", F.trunc(F.to_date("l_shipdate"), "month").alias("trade_date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close")
    )


BARS = """bars_type AS (SELECT event_type AS symbol, ts::DATE AS trade_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY ALL),
bars_supp AS (SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, date_trunc('month', l_shipdate)::DATE AS trade_date,
  first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close
  FROM lineitem GROUP BY ALL)"""


def bars_flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_supp with flaws: high and low swapped in some symbols' Mays, no close in others' Aprils."""
    bars = bars_supp(spark, sf_dir)
    key, month = F.col("symbol").cast("int") % 20, F.month("trade_date")
    swap = (key == 3) & (month == 5)
    return bars.select(
        "symbol",
        "trade_date",
        "open",
        F.when(swap, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(swap, F.col("high")).otherwise(F.col("low")).alias("low"),
        F.when(~((key == 7) & (month == 4)), F.col("close")).alias("close"),
    )


def drifted_prices() -> dict[str, Column]:
    """The four prices of bars_drift over a row of bars_supp: its noise bounded and a course per symbol, rising, falling,
    turning up once or after a double bottom."""
    key = F.col("symbol").cast("int") % 5
    month = (F.year("trade_date") - 1992) * 12 + F.month("trade_date")

    def bend(m):
        k = m % 40
        twice = F.when(k < 16, 16 - k).when(k < 20, k - 16).when(k < 24, 24 - k).otherwise(k - 24)
        return 1500.0 + F.when(key == 0, m * 6.0).when(key == 1, m * -6.0).when(key == 3, twice * 7.0).otherwise(F.abs((m + key * 5) % 40 - 22) * 7.0)

    # A bar takes the middle half of its month's step, so that steps leave gaps between quiet bars; before they turn, bars are wide.
    falls = F.when(key == 3, month % 40 < 16).otherwise((key > 1) & ((month + key * 5) % 40 < 22))
    scale = F.when(falls, 12.0).otherwise(0.3 * (F.col("symbol").cast("int") % 7 + 1))
    start, step = bend(month), bend(month + 1) - bend(month)
    shifts = {"open": 0.25, "high": F.when(step > 0, 0.75).otherwise(0.25), "low": F.when(step > 0, 0.25).otherwise(0.75), "close": 0.75}
    return {c: F.col(c) / (F.col(c) + 1000.0) * scale + start + step * by for c, by in shifts.items()}


def _bend_sql(m: str) -> str:
    k = f"({m} % 40)"
    twice = f"CASE WHEN {k} < 16 THEN 16 - {k} WHEN {k} < 20 THEN {k} - 16 WHEN {k} < 24 THEN 24 - {k} ELSE {k} - 24 END"
    return f"(1500.0::DOUBLE + CASE key WHEN 0 THEN {m} * 6.0::DOUBLE WHEN 1 THEN {m} * -6.0::DOUBLE WHEN 3 THEN ({twice}) * 7.0::DOUBLE ELSE abs(({m} + key * 5) % 40 - 22) * 7.0::DOUBLE END)"


DRIFT = f"""bars_drift AS (SELECT symbol, trade_date, open / (open + 1000.0::DOUBLE) * scale + b0 + step * 0.25::DOUBLE AS open,
  high / (high + 1000.0::DOUBLE) * scale + b0 + step * CASE WHEN step > 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS high,
  low / (low + 1000.0::DOUBLE) * scale + b0 + step * CASE WHEN step > 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS low, close / (close + 1000.0::DOUBLE) * scale + b0 + step * 0.75::DOUBLE AS close
  FROM (SELECT *, CASE WHEN (key = 3 AND m % 40 < 16) OR (key IN (2, 4) AND (m + key * 5) % 40 < 22) THEN 12.0::DOUBLE ELSE 0.3::DOUBLE * (symbol::INT % 7 + 1) END AS scale,
    {_bend_sql("m")} AS b0, {_bend_sql("(m + 1)")} - {_bend_sql("m")} AS step
  FROM (SELECT *, symbol::INT % 5 AS key, (year(trade_date) - 1992) * 12 + month(trade_date) AS m FROM bars_supp)))"""

FLAWED = """bars_flawed AS (SELECT symbol, trade_date, open, CASE WHEN symbol::INT % 20 = 3 AND month(trade_date) = 5 THEN low ELSE high END AS high,
  CASE WHEN symbol::INT % 20 = 3 AND month(trade_date) = 5 THEN high ELSE low END AS low, CASE WHEN symbol::INT % 20 = 7 AND month(trade_date) = 4 THEN NULL ELSE close END AS close FROM bars_supp)"""


def stock_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sector, sector_rank, stock_rank, stock_code, stock_name, s_suppkey: suppliers ranked within their nations."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    totals = rows.groupBy("n_name").agg(F.round(F.sum("s_acctbal"), 2).alias("total"))
    ranked = totals.withColumn("sector_rank", F.dense_rank().over(Window.orderBy(F.col("total").desc(), "n_name"))).drop("total")  # 25 nations
    place = F.row_number().over(Window.partitionBy("n_name").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    return rows.withColumn("stock_rank", place).join(F.broadcast(ranked), "n_name").select(
        F.col("n_name").alias("sector"), "sector_rank", "stock_rank", F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code"), F.col("s_name").alias("stock_name"), "s_suppkey"
    )


POOL = """pool_rows AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
pool_sectors AS (SELECT n_name, dense_rank() OVER (ORDER BY total DESC, n_name) AS sector_rank FROM (SELECT n_name, round(sum(s_acctbal), 2) AS total FROM pool_rows GROUP BY n_name)),
stock_pool AS (SELECT n_name AS sector, sector_rank, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS stock_rank,
  lpad(s_suppkey::VARCHAR, 6, '0') AS stock_code, s_name AS stock_name, s_suppkey FROM pool_rows JOIN pool_sectors USING (n_name))"""


def pool_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_pool with every seventh stock listed in a further sector too."""
    pool = stock_pool(spark, sf_dir)
    again = pool.where(F.col("s_suppkey") % 7 == 0).withColumns({"sector": F.lit("ALSO"), "sector_rank": F.lit(99)})
    return pool.unionByName(again)


POOL_TWICE = """pool_twice AS (SELECT sector, sector_rank, stock_rank, stock_code, stock_name, s_suppkey FROM stock_pool
  UNION ALL SELECT 'ALSO', 99, stock_rank, stock_code, stock_name, s_suppkey FROM stock_pool WHERE s_suppkey % 7 = 0)"""


def tech_results(pool: DataFrame) -> DataFrame:
    """stock_code, analysis_status and minutes since its update, by s_suppkey % 5; the fifth part has no row."""
    kind = F.col("s_suppkey") % 5
    return pool.where(kind < 4).select(
        "stock_code",
        F.element_at(F.array(*map(F.lit, ("succeeded", "failed", "running", "running"))), (kind + 1).cast("int")).alias("analysis_status"),
        F.when(kind == 3, F.lit(30)).otherwise(F.lit(5)).alias("age_minutes"),
    )


RESULTS = """tech_results AS (SELECT stock_code, CASE s_suppkey % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'running' END AS analysis_status,
  CASE WHEN s_suppkey % 5 = 3 THEN 30 ELSE 5 END AS age_minutes FROM stock_pool WHERE s_suppkey % 5 < 4)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session: the weekday dates on which any bar stands."""
    days = bars_type(spark, sf_dir).select("trade_date").union(bars_supp(spark, sf_dir).select("trade_date"))
    return days.distinct().where(F.weekday("trade_date") < 5).select(F.col("trade_date").alias("session"))


CALENDAR = "calendar AS (SELECT DISTINCT trade_date AS session FROM (SELECT trade_date FROM bars_type UNION ALL SELECT trade_date FROM bars_supp) WHERE isodow(trade_date) < 6)"
