"""Bars in months and buckets: plans without an exchange by symbol, pruned months, results as without the layout."""

import pytest
from pyspark.sql import functions as F

from tickerloom.functions.payloads import index_snapshot
from tickerloom.operators import bars as B
from tickerloom.operators import price_action as P
from tickerloom.operators.bar_store import store_bars, stored_bars, stored_months
from tickerloom.operators.panels import panel_bars

BUCKETS = 3


@pytest.fixture(scope="module")
def rows(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 120).cast("int"))
    n = F.col("id")
    price = 10.0 + F.sin(n * 0.7) + (n % 120) * 0.05
    return spark.range(120 * 7).select(F.lpad((n / 120).cast("int").cast("string"), 6, "0").alias("symbol"), day.alias("trade_date"), price.alias("open"), (price + 0.4).alias("high"), (price - 0.3).alias("low"), (price + F.cos(n * 1.3) * 0.2).alias("close")).cache()


@pytest.fixture(scope="module")
def name(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('bars')}/t"
    store_bars(rows.where("trade_date < '2024-03-01'"), "bar_store_test", path, BUCKETS)
    store_bars(rows.where("trade_date >= '2024-03-01'"), "bar_store_test", path, BUCKETS)
    yield "bar_store_test"
    spark.sql("DROP TABLE bar_store_test")


def exchanged_scans(df):
    """Exchanges of a plan that has run under which bars are scanned; a pool's own do not count."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out = []
    for i, line in enumerate(lines):
        if "Exchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                if "FileScan parquet" in below:
                    out.append(line)
    return out


def test_windows_and_groupings_need_no_exchange(spark, rows, name):
    found = P.structures(stored_bars(spark, name))
    assert not exchanged_scans(found) and exchanged_scans(P.structures(stored_bars(spark, name).repartition(2)))
    columns = [c for c, kind in found.dtypes if not kind.startswith("array")]
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert {key(r) for r in found.select(columns).collect()} == {key(r) for r in P.structures(rows).select(columns).collect()}


def test_joins_with_few_symbols_need_no_exchange_of_bars(spark, rows, name):
    pool = spark.createDataFrame([("000001",), ("000004",)], "stock_code string")
    last = B.recent_bars(stored_bars(spark, name), F.broadcast(pool), "2024-04-10")
    assert not exchanged_scans(last)
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in B.recent_bars(rows, pool, "2024-04-10").select(last.columns).collect()}
    results = spark.createDataFrame([("1", "2024-02-20"), ("4", "2024-01-05")], "stock_code string, end string")
    results = results.select("stock_code", F.to_date("end").alias("kline_trade_date_end"), F.lit(None).cast("array<struct<trade_date:date,open:double,high:double,low:double,close:double>>").alias("input_bars"))
    panel = panel_bars(F.broadcast(results), stored_bars(spark, name))
    assert {(r.stock_code, r.snapshot and r.snapshot.trade_date.isoformat()) for r in panel.collect()} == {("000001", "2024-02-20"), ("000004", "2024-01-05")}


def test_dates_prune_months(spark, rows, name):
    assert stored_months(spark, name) == ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]
    part = stored_bars(spark, name, first="2024-02-10", last="2024-02-20")
    assert part.count() == 7 * 11 == rows.where("trade_date BETWEEN '2024-02-10' AND '2024-02-20'").count()
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in scan
    assert {f.split("month=")[1][:7] for f in part.select("_metadata.file_path").distinct().toPandas()["file_path"]} == {"2024-02"}


def test_an_absent_index_is_an_error(spark):
    quotes = [(c, "1.5") for c in ("1", "399001", "399006", "688", "899050")]
    frame = lambda rows: spark.createDataFrame([(c, *[v] * 7) for c, v in rows], "f12 string, " + ", ".join(f"{f} string" for f in ("f2", "f3", "f4", "f15", "f16", "f17", "f18")))
    assert [r.index_code for r in index_snapshot(frame(quotes)).collect()] == ["000001", "399001", "399006", "000688", "899050"]
    with pytest.raises(Exception, match="no quote of index 000688"):
        index_snapshot(frame([q for q in quotes if q[0] != "688"])).collect()
