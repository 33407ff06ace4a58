"""Daily bars: as-of selection, validity, window features, pivots, EMA and per-symbol market context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the price-action rules.
EMA_PERIOD = 20
TINY = 1e-9
MIN_BARS = 30
STATUSES = ("running", "succeeded", "failed", "skipped_data_insufficient")


def valid_bars(bars: DataFrame) -> DataFrame:
    """Bars whose date and four prices are all there."""
    return bars.na.drop(subset=["trade_date", "open", "high", "low", "close"])


def bar_faults(bars: DataFrame) -> DataFrame:
    """Bars whose high or low contradicts the other prices."""
    top, bottom = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    return bars.where((F.col("high") < top) | (F.col("low") > bottom))


def recent_bars(bars: DataFrame, pool: DataFrame, end_date: str, limit: int = MIN_BARS) -> DataFrame:
    """The last limit bars, up to and including end_date, of every pool stock; the cut precedes the check of prices.

    The pool's symbols go first, so that other symbols' bars are never sorted; the window's limit applies before the
    exchange too.
    """
    wanted = bars.where(F.col("trade_date") <= F.lit(end_date).cast("date")).join(pool.select(F.col("stock_code").alias("symbol")).distinct(), "symbol", "left_semi")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    return valid_bars(wanted.withColumn("place", place).where(F.col("place") <= limit).drop("place"))


def as_of_sets(bars: DataFrame, ends: list[str], limit: int = MIN_BARS) -> DataFrame:
    """The last limit bars of every symbol as of each of ends: bars with end, symbol being symbol@end.

    Rows grow with the ends, not with the history.
    """
    rows = ends_held(bars, ends, limit).withColumn("end", F.explode("__ends")).drop("__ends")
    return rows.withColumn("symbol", F.concat("symbol", F.lit("@"), F.col("end").cast("string")))


def ends_held(bars: DataFrame, ends: list[str], limit: int = MIN_BARS) -> DataFrame:
    """bars with __ends, those of ends as of which a bar is one of its symbol's last limit bars.

    A bar tells for which ends it is the last one, by the date of the next, and takes what the limit - 1 bars after it
    tell too: two windows of one partition and order, no join.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    dates = F.array(*[F.lit(e).cast("date") for e in ends])
    date, following = F.col("trade_date"), F.col("__next")
    known = bars.withColumn("__next", F.lead("trade_date").over(w))
    last_for = F.filter(dates, lambda e: (e >= date) & (following.isNull() | (e < following)))
    # Most bars are the last one for no end; nulls are not collected.
    told = known.withColumn("__last", last_for).withColumn("__last", F.when(F.size("__last") > 0, F.col("__last"))).drop("__next")
    held = F.flatten(F.collect_list("__last").over(w.rowsBetween(0, limit - 1)))
    return told.withColumn("__ends", held).drop("__last")


def _range(high: str = "high", low: str = "low") -> Column:
    return F.greatest(F.col(high) - F.col(low), F.lit(TINY))


def bar_kind() -> Column:
    """bull_trend, bear_trend or tr_bar."""
    size = _range()
    body = F.abs(F.col("close") - F.col("open")) / size
    upper = (F.col("high") - F.greatest("open", "close")) / size
    lower = (F.least("open", "close") - F.col("low")) / size
    return (
        F.when((F.col("close") > F.col("open")) & (body >= 0.5) & (upper <= 0.25), F.lit("bull_trend"))
        .when((F.col("close") < F.col("open")) & (body >= 0.5) & (lower <= 0.25), F.lit("bear_trend"))
        .otherwise(F.lit("tr_bar"))
    )


def bar_features(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every bar with its kind, its shape against the bar before, pivots among its neighbours and their strength.

    All windows share partition and order, so one exchange and one sort serve them. by names a series of bars.
    """
    w = Window.partitionBy(*by).orderBy("trade_date")
    p_high, p_low = F.lag("high").over(w), F.lag("low").over(w)
    near = [("high", F.greatest), ("low", F.least)]
    out = bars.withColumns(
        {
            "idx": F.row_number().over(w) - 1,
            "kind": bar_kind(),
            "inside": F.coalesce((F.col("high") <= p_high) & (F.col("low") >= p_low), F.lit(False)),
            "outside": F.coalesce((F.col("high") >= p_high) & (F.col("low") <= p_low), F.lit(False)),
            "near_high": F.col("close") >= F.col("high") - 0.25 * _range(),
            "near_low": F.col("close") <= F.col("low") + 0.25 * _range(),
            "overlap": F.least(F.col("high"), p_high) - F.greatest(F.col("low"), p_low) > 0,
            "tail_heavy": F.abs(F.col("close") - F.col("open")) / _range() < 0.35,
            "prev_close": F.lag("close").over(w),
            "avg_range20": F.avg(F.col("high") - F.col("low")).over(w.rowsBetween(-19, 0)),
            "prior_high20": F.max("high").over(w.rowsBetween(-20, -1)),
            "rises": F.col("low") >= p_low,
            "falls": F.col("high") <= p_high,
        }
    )
    around = {name: fn(*[f(name, k).over(w) for f in (F.lag, F.lead) for k in (1, 2)]) for name, fn in near}
    whole = F.lag("high", 2).over(w).isNotNull() & F.lead("high", 2).over(w).isNotNull()
    return out.withColumns({"pivot_high": whole & (F.col("high") >= around["high"]), "pivot_low": whole & (F.col("low") <= around["low"])})


def ema(bars: DataFrame, period: int = EMA_PERIOD) -> DataFrame:
    """symbol and ema, the exponential average of its closes in order of time, seeded by the first.

    A fold over one symbol's ordered closes: a symbol's bars are as many as its trading days.
    """
    alpha = 2.0 / (period + 1)
    closes = F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "close"))), lambda b: b["close"])
    rows = bars.groupBy("symbol").agg(closes.alias("closes"))
    rest = F.slice("closes", F.lit(2), F.size("closes"))
    folded = F.aggregate(rest, F.get("closes", 0), lambda acc, c: acc + alpha * (c - acc))
    return rows.select("symbol", folded.alias("ema"))


def stock_context(bars: DataFrame) -> DataFrame:
    """Per symbol: how many bars, first and last date, last close, highest high, lowest low, and the bars themselves in order.

    For bars that a limit per symbol has cut (recent_bars).
    """
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars_count"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.max_by("close", "trade_date").alias("last_close"),
        F.max("high").alias("max_high"),
        F.min("low").alias("min_low"),
        F.array_sort(F.collect_list(F.struct("trade_date", "open", "high", "low", "close"))).alias("input_bars"),
    )


def symbols_distinct(bars: DataFrame) -> DataFrame:
    """symbol, the name on its newest bar, and that bar's date."""
    return bars.groupBy("symbol").agg(F.max_by("name", "trade_date").alias("name"), F.max("trade_date").alias("last_date"))


def has_trade_date(bars: DataFrame, dates: list[str]) -> DataFrame:
    """trade_date and present, for every one of dates: a semi join that reads dates alone."""
    asked = bars.sparkSession.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d").alias("trade_date"))
    there = bars.where(F.col("trade_date").isin([F.to_date(F.lit(d)) for d in dates])).select("trade_date").distinct().withColumn("there", F.lit(True))
    return asked.join(F.broadcast(there), "trade_date", "left").select("trade_date", F.coalesce("there", F.lit(False)).alias("present"))


def not_loaded(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of trading dates of which nothing is stored yet: what a resumed load still has to do."""
    return rows.join(stored.select("trade_date").distinct(), "trade_date", "left_anti")


def claim_plan(pool: DataFrame, results: DataFrame, stale_minutes: int = 10) -> DataFrame:
    """What a run does with every pool row: succeeded and freshly running stocks are skipped, others are (re)tried.

    Of a stock in several sectors the first copy by sector and stock rank counts, the rest is another worker's.
    """
    copy = F.row_number().over(Window.partitionBy("stock_code").orderBy("sector_rank", "stock_rank"))
    status, age = F.col("analysis_status"), F.col("age_minutes")
    plan = (
        F.when(status == "succeeded", "skip_succeeded")
        .when(F.col("copy") > 1, "skipped_by_other_worker")
        .when(status.isNull(), "insert")
        .when(status.isin("failed", "skipped_data_insufficient"), "retry")
        .when((status == "running") & (age > stale_minutes), "take_over")
        .otherwise("skip_running")
    )
    return pool.withColumn("copy", copy).join(results, "stock_code", "left").withColumn("plan", plan).drop("copy")


def run_stats(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of counts over claim_plan's rows and the claimed stocks' outcomes (stock_code, analysis_status).

    Succeeded stocks count once each, however many sectors list them; a freshly running one is another worker's.
    """
    done = outcomes.select("stock_code", F.col("analysis_status").alias("outcome"))
    rows = plan.withColumn("claims", F.col("plan").isin("insert", "retry", "take_over")).join(done, "stock_code", "left")
    ended = lambda s: F.count_if(F.col("claims") & (F.col("outcome") == s))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(F.col("plan") == "skip_succeeded", F.col("stock_code"))).alias("pre_skipped_succeeded"),
        F.count_if(F.col("plan") != "skip_succeeded").alias("to_process"),
        F.count_if("claims").alias("claimed"),
        *[ended(s).alias(s) for s in STATUSES[1:]],
        F.count_if(F.col("plan").isin("skip_running", "skipped_by_other_worker")).alias("skipped_by_other_worker"),
    )


def sessions_asof(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days (a column day, any others) with session, the one on or before it, and previous, the one before that; rows
    before the first session are dropped.

    Every session stands for the days until the next one, so this is an equi-join with a row per calendar day; days
    after the last session take that one, a single row.
    """
    w = Window.orderBy("session")  # a row per trading day
    known = calendar.select("session", F.lag("session").over(w).alias("previous"), F.lead("session").over(w).alias("next"))
    filled = known.where("next IS NOT NULL").select("session", "previous", F.explode(F.sequence("session", F.date_sub("next", 1))).alias("day"))
    last = known.where("next IS NULL").select(F.col("session").alias("last_session"), F.col("previous").alias("last_previous"))
    joined = days.join(filled, "day", "left").join(F.broadcast(last))
    late = F.col("day") >= F.col("last_session")
    out = joined.withColumns({"session": F.when(late, F.col("last_session")).otherwise(F.col("session")), "previous": F.when(late, F.col("last_previous")).otherwise(F.col("previous"))})
    return out.where("session IS NOT NULL").drop("last_session", "last_previous")


def trade_dates(moments: DataFrame, calendar: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """moments (a column ts, epoch seconds) with the trading dates that hold then.

    trade_date and prev_trade_date: of the local day from nine o'clock on, else of the day before. morning_date and
    morning_prev: of the local day at any hour. is_session: whether the local day is one. target_date: trade_date on a
    session day, else prev_trade_date, so on a Saturday the session before Friday's, as the source of these rules has it.
    """
    local = F.from_utc_timestamp(F.timestamp_seconds("ts"), zone)
    day = F.to_date(local)
    days = moments.select(day.alias("day")).distinct()
    days = days.union(days.select(F.date_sub("day", 1))).distinct()
    known = sessions_asof(days, calendar)
    here = known.select(F.col("day").alias("__day"), F.col("session").alias("morning_date"), F.col("previous").alias("morning_prev"))
    by_hour = known.select(F.col("day").alias("__at"), F.col("session").alias("trade_date"), F.col("previous").alias("prev_trade_date"))
    rows = moments.withColumns({"__day": day, "__at": F.when(F.hour(local) >= 9, day).otherwise(F.date_sub(day, 1))})
    out = rows.join(here, "__day", "left").join(by_hour, "__at", "left")
    is_session = F.coalesce(F.col("morning_date") == F.col("__day"), F.lit(False))
    return out.withColumns({"is_session": is_session, "target_date": F.when(is_session, F.col("trade_date")).otherwise(F.col("prev_trade_date"))}).drop("__day", "__at")
