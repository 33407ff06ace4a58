"""Price action, decisions, the batch and the scan on hand-made bars."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import bars as B
from tickerloom.operators import decision as D
from tickerloom.operators import price_action as P
from tickerloom.plans import bar_queries

SCHEMA = "symbol string, trade_date date, open double, high double, low double, close double"
START = datetime.date(2025, 12, 1)


def table(spark, prices, symbol="s"):
    return spark.createDataFrame([(symbol, START + datetime.timedelta(days=i), *map(float, p)) for i, p in enumerate(prices)], SCHEMA)


def steps(n):
    return [(10 + 0.01 * i, 10.3 + 0.01 * i, 9.8 + 0.01 * i, 10.1 + 0.01 * i) for i in range(n)]


def test_ema_of_long_series_against_loop(spark):
    """Over several chunks, and exactly the price where it never changes."""
    closes = [100 + (i * 7919 % 101) / 7 for i in range(3 * P.EMA_CHUNK + 17)]
    rows = table(spark, [(c, c, c, c) for c in closes]).union(table(spark, [(3.3,) * 4] * 700, "flat"))
    got = {}
    for r in P.with_ema(rows).orderBy("trade_date").collect():
        got.setdefault(r.symbol, []).append(r.ema)
    want = list(itertools.accumulate(closes, lambda acc, c: 2 / 21 * c + 19 / 21 * acc))
    assert got["s"] == pytest.approx(want, rel=1e-12) and set(got["flat"]) == {3.3}
    assert B.ema(rows.where("symbol = 's'")).first().ema == pytest.approx(want[-1], rel=1e-12)


def test_short_series_have_no_decision_and_thirty_bars_all_fields(spark):
    assert D.analysed(table(spark, steps(10))).count() == 0 and D.analysed(table(spark, steps(29))).count() == 0
    found = D.markdown(D.analysed(table(spark, steps(30)))).first().asDict()
    assert found["conclusion"] == D.NOT_BUY and all(found[f] for f in D.FIELDS if f not in ("buy_price", "stop_loss", "take_profit"))
    assert found["buy_price"] is None and found["formatted_markdown"].startswith("# 是否是买点\n- 结论：不买\n\n# 通道情况")
    chart = D.chart_text(table(spark, steps(30))).first().chart
    assert chart.splitlines()[-1] == "- 2025-12-30: O=10.29, H=10.59, L=10.09, C=10.39" and chart.count("\n- 2025-12") == 5


def breakout_bars():
    """A level market whose last bar jumps above all before, near its high."""
    flat = [(100 + (i % 3), 102.5 + (i % 2), 98.5 - (i % 2), 101 - (i % 3) * 0.5) for i in range(33)]
    return [*flat, (101, 103, 100.5, 102.8), (102.8, 106, 102.5, 105.9)]


def test_breakout_is_bought_with_its_prices(spark):
    found = D.setups(P.structures(table(spark, breakout_bars()))).first()
    assert found.b_found and found.breakout_not is None and found.setup == "breakout" and found.hold is None
    assert found.entry == 106 and found.stop == 100.5 and found.probability == 0.5
    risk = 106 - 100.5
    assert found.target == max(found.recent_high, 103.5 + 106 - 97.5, 106 + 1.8 * risk)
    decided = D.decisions(D.setups(P.structures(table(spark, breakout_bars())))).first()
    assert decided.conclusion == D.BUY and decided.buy_price == "突破 106 上方的突破单入场" and decided.stop_loss.startswith("100.5 下方")
    assert decided.key_candle.endswith("，并突破 103.5") and decided.expected_entry is None and decided.current_pattern == "有效向上突破"


def test_pivots_of_one_bar_that_is_both(spark):
    prices = [(10, 11, 9, 10)] * 12 + [(10, 20, 1, 10)] + [(10, 11, 9, 10)] * 12
    found = {(r.kind, r.strength): r.price for r in P.pivots(P.frame(table(spark, prices))).where("idx = 12").collect()}
    assert found == {("high", "major"): 20, ("low", "major"): 1}


def test_pullback_starts_where_highs_stop_rising_backwards(spark):
    highs = [10 + i for i in range(26)] + [34, 33, 32, 31]
    prices = [(h - 0.8, h, h - 1, h - 0.2) for h in highs]
    found = P.structures(table(spark, prices)).first()
    assert found.start_back == 5 and found.swing_low == 30 and found.attempts == 0  # the last bar's high is below 34's; 35 began it


def test_as_of_sets_hold_the_last_bars_at_each_date(spark):
    rows = table(spark, steps(40))
    ends = ["2025-11-01", "2025-12-05", "2026-01-05", "2027-01-01"]
    found = {(r.symbol, r.n, str(r.a), str(r.b)) for r in B.as_of_sets(rows, ends, 10).groupBy("symbol").agg(F.count("*").alias("n"), F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).collect()}
    assert found == {("s@2025-12-05", 5, "2025-12-01", "2025-12-05"), ("s@2026-01-05", 10, "2025-12-27", "2026-01-05"), ("s@2027-01-01", 10, "2025-12-31", "2026-01-09")}


@pytest.fixture(scope="module")
def pool(spark):
    codes = ["done", "fresh", "stale", "broke", "new", "short", "wrong", "none", "many"]
    rows = [("a", 1, i + 1, c, c.title()) for i, c in enumerate(codes)] + [("b", 2, 1, "new", "New"), ("b", 2, 2, "done", "Done")]
    return spark.createDataFrame(rows, "sector string, sector_rank int, stock_rank int, stock_code string, stock_name string")


def test_batch_statuses_and_statistics(spark, pool):
    results = spark.createDataFrame([("done", "succeeded", 99), ("fresh", "running", 5), ("stale", "running", 11), ("broke", "failed", 1)], "stock_code string, analysis_status string, age_minutes int")
    data = [table(spark, steps(n), c) for c, n in (("done", 40), ("fresh", 40), ("stale", 40), ("broke", 30), ("new", 30), ("short", 19), ("wrong", 31), ("many", 25))]
    rows = data[0]
    for d in data[1:]:
        rows = rows.union(d)
    rows = rows.withColumn("high", F.when((F.col("symbol") == "wrong") & (F.col("trade_date") == "2025-12-20"), F.lit(1.0)).otherwise(F.col("high")))
    out = D.stock_tech_batch(pool, results, rows, "2026-03-01")
    found = {r.stock_code: r for r in out.collect()}
    assert {c: r.analysis_status for c, r in found.items()} == {"stale": "succeeded", "broke": "succeeded", "new": "succeeded", "short": "skipped_data_insufficient", "wrong": "failed", "none": "skipped_data_insufficient", "many": "failed"}
    assert found["short"].error_message == "kline bars insufficient, need >=20, got 19" and found["none"].bars_count == 0
    assert found["wrong"].error_message == D.BAD_HIGH and found["many"].error_message == D.TOO_FEW and found["new"].error_message is None
    assert len(found["new"].input_bars) == 30 and found["new"].sector == "a" and found["stale"].kline_trade_date_start == datetime.date(2025, 12, 11)
    stats = B.run_stats(B.claim_plan(pool, results), out).first().asDict()
    assert stats == {"total": 11, "pre_skipped_succeeded": 1, "to_process": 9, "claimed": 7, "succeeded": 3, "failed": 2, "skipped_data_insufficient": 2, "skipped_by_other_worker": 2}
    # The end date counts, and earlier bars than the last thirty don't.
    early = {r.stock_code: r for r in D.stock_tech_batch(pool, results, rows, "2025-12-30").collect()}
    assert early["stale"].kline_trade_date_end == datetime.date(2025, 12, 30) and early["stale"].bars_count == 30


def test_scan_statuses_report_and_summary(spark, tmp_path):
    history = table(spark, steps(35), "a").union(table(spark, steps(20), "b")).union(table(spark, steps(120), "c"))
    snapshot = spark.createDataFrame([("a", "A", 10.3, 10.6, 10.1, 10.5), ("b", "B", 10.3, 10.6, 10.1, 10.5), ("c", "C", 10.3, 9.0, 10.1, 10.5), ("d", "D", None, 1.0, 1.0, 1.0), (None, "E", 1.0, 1.0, 1.0, 1.0)], "symbol string, name string, open double, high double, low double, close double")
    scanned = D.market_scan(snapshot, history, "2026-06-01", "2026-05-29")
    found = {r.name: (r.status, r.bars_count) for r in scanned.collect()}
    assert found == {"A": ("succeeded", 36), "B": ("skipped_data_insufficient", 21), "C": ("failed", 90), "D": ("skipped_invalid_current_snapshot", None), "E": ("skipped_invalid_current_snapshot", None)}
    D.write_report(scanned, str(tmp_path / "all"))
    D.write_report(scanned, str(tmp_path / "buys"), buy_only=True)
    assert spark.read.json(str(tmp_path / "all/items")).count() == 5 and spark.read.json(str(tmp_path / "buys/items")).where("status = 'succeeded'").count() == scanned.where("conclusion = '买'").count()
    assert spark.read.json(str(tmp_path / "all/summary")).first()["skipped_invalid_current_snapshot"] == 2


def test_trade_dates_at_nine_and_on_weekends(spark):
    days = [datetime.date(2026, 4, d) for d in (13, 14, 15, 16, 17, 20)]
    calendar = spark.createDataFrame([(d,) for d in days], "session date")
    utc = lambda *a: int(datetime.datetime(*a, tzinfo=datetime.UTC).timestamp())
    moments = {"before": utc(2026, 4, 17, 0, 59), "nine": utc(2026, 4, 17, 1, 0), "saturday": utc(2026, 4, 18, 4, 0), "monday": utc(2026, 4, 20, 0, 30), "after": utc(2026, 4, 25, 3, 0), "first": utc(2026, 4, 13, 3, 0), "never": utc(2026, 1, 1, 3, 0)}
    rows = spark.createDataFrame(list(moments.items()), "name string, ts bigint")
    found = {r.name: (r.trade_date, r.prev_trade_date, r.morning_date, r.is_session, r.target_date) for r in B.trade_dates(rows, calendar).collect()}
    d = lambda n: datetime.date(2026, 4, n)
    assert found["before"] == (d(16), d(15), d(17), True, d(16)) and found["nine"] == (d(17), d(16), d(17), True, d(17))
    assert found["saturday"] == (d(17), d(16), d(17), False, d(16))  # two sessions back, as the rules have it
    assert found["monday"] == (d(17), d(16), d(20), True, d(17)) and found["after"] == (d(20), d(17), d(20), False, d(17))
    assert found["first"] == (d(13), None, d(13), True, d(13)) and found["never"] == (None, None, None, False, None)


@pytest.mark.parametrize("query", ["setups", "decision", "pullback", "market_state", "reversal", "wedges", "signal_text"])
def test_sets_of_bars_cost_one_exchange_and_no_join(spark, query):
    plan = bar_queries.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_series_are_told_apart_by_all_their_columns(spark):
    rows = table(spark, breakout_bars()).withColumn("end", F.lit("a")).union(table(spark, steps(35)).withColumn("end", F.lit("b"))).union(table(spark, steps(31)).withColumn("end", F.lit(None)))
    got = {r["end"]: r for r in P.structures(rows, ("symbol", "end")).drop("symbol").collect()}
    one = {end: P.structures(table(spark, prices)).drop("symbol").first() for end, prices in (("a", breakout_bars()), ("b", steps(35)), (None, steps(31)))}
    assert {end: tuple(r[c] for c in one[end].__fields__) for end, r in got.items()} == {end: tuple(r) for end, r in one.items()}


def test_bars_hold_the_ends_that_a_loop_finds(spark):
    dates = [None, *[START + datetime.timedelta(days=d) for d in (0, 1, 3, 4, 9, 10, 20)]]
    ends = [str(START + datetime.timedelta(days=d)) for d in (-1, 0, 2, 3, 9, 15, 19, 20, 99)]
    rows = spark.createDataFrame([("s", d, 1.0, 1.0, 1.0, 1.0) for d in dates], SCHEMA)
    got = {r.trade_date: {str(e) for e in r["__ends"]} for r in B.ends_held(rows, ends, 3).collect()}
    want = {d: set() for d in dates}
    for e in ends:
        upto = [i for i, d in enumerate(dates) if d and str(d) <= e]
        for d in dates[max(upto[-1] - 2, 0) : upto[-1] + 1] if upto else []:
            want[d].add(e)
    assert got == want
