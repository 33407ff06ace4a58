"""Price action of a symbol's bars: always-in side, market state, phase, breakout, pullback, reversal, wedges.

frame() adds to every bar what its neighbours and its place from the end (back = 1 is the last bar) say, by windows that
all share one partition and order. facts() folds a symbol's rows once into a row of counts, extremes and marked bars;
everything below it is an expression over that row. So a symbol's bars are shuffled once and sorted once (and once more
in chunks for the moving average), whatever is asked of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.bars import EMA_PERIOD, TINY, bar_features

# Fixed values of the rules: extension of a close beyond its average (share, ranges), bars since a touch, bars above.
LATE = (0.08, 3.0, 8, 16)
CLIMAX = (0.12, 4.0, 12, 18)
MIDDLE = (0.03, 1.2, 10)
BIG_RANGE, STRONG_BODY = 1.5, 0.55
RANGE_MIDDLE = (0.33, 0.67)
LOOKBACK, SIDE_BARS, MOST_PULLBACK = 20, 10, 14

#: Rows of a chunk of the moving average; (19 / 21) ** (2 * EMA_CHUNK) is below a double's precision.
EMA_CHUNK = 256


def with_ema(features: DataFrame, period: int = EMA_PERIOD, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """features with ema, as _with_ema has it."""
    return _with_ema(features, period, by).drop("__chunk")


def _with_ema(features: DataFrame, period: int, by: tuple[str, ...]) -> DataFrame:
    """features with ema, every bar's exponential average, seeded by the symbol's first close, and __chunk, which grows
    with the date: windows ordered by both need no other sort than the average's.

    Linear in a symbol's bars: within a chunk the average is a running sum of weighted closes, and what earlier chunks
    leave to it is their own last averages, of which two reach a double's precision. Closes count from the first one,
    so that an unchanging close is its own average exactly.
    """
    alpha = 2.0 / (period + 1)
    keep = 1.0 - alpha
    w = Window.partitionBy(*by).orderBy("trade_date")
    part = Window.partitionBy(*by, "__chunk").orderBy("trade_date")
    chunks = Window.partitionBy(*by).orderBy("__chunk", "trade_date")
    place = F.row_number().over(w) - 1
    first = F.first("close").over(w)
    rows = features.withColumns({"__chunk": F.floor(place / EMA_CHUNK), "__k": F.pmod(place, F.lit(EMA_CHUNK)).cast("double"), "__first": first})
    weighted = (F.col("close") - F.col("__first")) * alpha * F.pow(F.lit(keep), -F.col("__k"))
    rows = rows.withColumn("__own", F.pow(F.lit(keep), F.col("__k")) * F.sum(weighted).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__end", F.last("__own").over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    earlier = F.coalesce(F.lag("__end", EMA_CHUNK).over(chunks), F.lit(0.0)) + keep**EMA_CHUNK * F.coalesce(F.lag("__end", 2 * EMA_CHUNK).over(chunks), F.lit(0.0))
    ema = F.col("__first") + F.col("__own") + F.pow(F.lit(keep), F.col("__k") + 1) * earlier
    return rows.withColumn("ema", ema).drop("__k", "__first", "__own", "__end")


def frame(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every bar with its features, average, place from the end, and what pivots and pullbacks need of its neighbours.

    by names a series of bars; where bars lie by its first column already, nothing is exchanged.
    """
    w = Window.partitionBy(*by).orderBy("__chunk", "trade_date")
    whole = Window.partitionBy(*by)
    ahead = w.rowsBetween(1, 8)
    back = F.col("back")
    rows = _with_ema(bar_features(bars, by), EMA_PERIOD, by).withColumn("range", F.greatest(F.col("high") - F.col("low"), F.lit(TINY)))
    rows = rows.withColumn("back", (F.count(F.lit(1)).over(whole) - F.col("idx")).cast("int"))
    ends_as = F.when((back <= LOOKBACK) & (F.col("pivot_high") | F.col("pivot_low")), F.when(F.col("pivot_low"), F.lit("low")).otherwise(F.lit("high")))
    rows = rows.withColumns(
        {
            "p_open": F.lag("open").over(w),
            "p_high": F.lag("high").over(w),
            "p_low": F.lag("low").over(w),
            "p_kind": F.lag("kind").over(w),
            "n_high": F.lead("high").over(w),
            "next_low": F.min("low").over(ahead),
            "next_high": F.max("high").over(ahead),
            "next_high_cut": F.max(F.when(back > 1, F.col("high"))).over(ahead),
            "size20": F.avg(F.when(back <= LOOKBACK, F.col("range"))).over(whole),
            "size21": F.avg(F.when(back.between(2, LOOKBACK + 1), F.col("range"))).over(whole),
            "pivot_before": F.last(ends_as, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "lows_so_far": F.sum(F.col("pivot_low").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "lows": F.sum(F.col("pivot_low").cast("int")).over(whole),
        }
    )
    # The pullback begins where highs stop rising backwards from the last bar, fourteen bars back at most.
    stops = F.min(F.when((back >= 2) & (F.col("high") < F.col("n_high")), back)).over(whole) - 1
    rows = rows.withColumn("start_back", F.least(F.coalesce(stops, F.max(back).over(whole)), F.lit(MOST_PULLBACK)))
    turned = (F.col("pivot_high") & F.coalesce(F.col("pivot_before") == "low", F.lit(False))).cast("int") + (
        F.col("pivot_low") & (F.col("pivot_high") | F.coalesce(F.col("pivot_before") == "high", F.lit(False)))
    ).cast("int")
    up_failed = (F.col("prev_close") > F.col("p_open")) & (F.col("close") < F.col("open")) & (F.col("close") <= F.col("p_open"))
    down_failed = (F.col("prev_close") < F.col("p_open")) & (F.col("close") > F.col("open")) & (F.col("close") >= F.col("p_open"))
    return rows.withColumns(
        {
            "low_back": F.when(F.col("pivot_low"), F.col("lows") - F.col("lows_so_far") + 1),
            "turns": F.when(back <= LOOKBACK, turned),
            "failed": F.col("p_kind").isin("bull_trend", "bear_trend") & (up_failed | down_failed),
            "body": F.abs(F.col("close") - F.col("open")),
            "up": F.col("close") > F.col("open"),
        }
    ).drop("__chunk")


def pivots(rows: DataFrame) -> DataFrame:
    """symbol, idx, back, price, kind and strength of every pivot of frame()'s rows; a bar that is both gives two.

    A pivot is major if the next eight bars move away from it by two average ranges of the symbol's last twenty bars.
    """
    tops = F.when(F.col("pivot_high"), F.struct(F.col("high").alias("price"), F.lit("high").alias("kind"), (F.col("high") - F.col("next_low")).alias("move")))
    bottoms = F.when(F.col("pivot_low"), F.struct(F.col("low").alias("price"), F.lit("low").alias("kind"), (F.col("next_high") - F.col("low")).alias("move")))
    found = rows.select("symbol", "idx", "back", "size20", F.explode(F.array_compact(F.array(tops, bottoms))).alias("p"))
    return found.select("symbol", "idx", "back", "p.price", "p.kind", F.when(F.col("p.move") >= 2 * F.col("size20"), F.lit("major")).otherwise(F.lit("minor")).alias("strength"))


def _last(column: str, n: int = 1) -> Column:
    return F.max(F.when(F.col("back") == n, F.col(column)))


def _among(condition: Column, column: str, fold=F.max) -> Column:
    return fold(F.when(condition, F.col(column)))


def facts(rows: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per symbol of what its bars show; rows is frame()."""
    back, near, start = F.col("back"), F.col("back") <= LOOKBACK, F.col("start_back")
    inner = (back < LOOKBACK) & (F.col("idx") > 0)
    side, pairs = back <= SIDE_BARS, (back < SIDE_BARS) & (F.col("idx") > 0)
    rises, falls = F.coalesce("rises", F.lit(False)), F.coalesce("falls", F.lit(False))
    high_pivot, low_pivot = F.col("pivot_high"), F.col("pivot_low")
    low_cut = low_pivot & (back >= 4)  # pivots of the bars without the last one
    major = lambda move, size: F.col(move) >= 2 * F.col(size)
    high_move, low_move, cut_move = F.col("high") - F.col("next_low"), F.col("next_high") - F.col("low"), F.col("next_high_cut") - F.col("low")
    shown = ("open", "high", "low", "close", "ema", "near_high", "near_low", "inside", "outside", "range", "p_open", "p_high", "p_low", "prev_close")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bars_count"),
        F.max("trade_date").alias("last_date"),
        *[_last(c).alias(c) for c in shown],
        _last("ema", 6).alias("ema6"),
        _last("close", 6).alias("close6"),
        F.max("size20").alias("avg_range"),
        _among(back <= 10, "range", F.avg).alias("avg_range10"),
        _among(near, "body", F.avg).alias("avg_body"),
        F.count_if(near & (F.col("kind") == "bull_trend")).alias("bull_bars"),
        F.count_if(near & (F.col("kind") == "bear_trend")).alias("bear_bars"),
        F.count_if(near & (F.col("kind") == "tr_bar")).alias("tr_bars"),
        F.count_if(inner & F.col("overlap")).alias("overlap_count"),
        F.count_if(inner & F.col("inside")).alias("inside_count"),
        F.count_if(near & F.col("tail_heavy")).alias("heavy_tails"),
        F.min(F.when(~rises, back)).alias("bull_micro"),
        F.min(F.when(~falls, back)).alias("bear_micro"),
        _among(near, "high").alias("high20"),
        _among(near, "low", F.min).alias("low20"),
        F.count_if(side & (F.col("kind") == "bull_trend")).alias("side_bull"),
        F.count_if(side & (F.col("kind") == "bear_trend")).alias("side_bear"),
        F.count_if(side & (F.col("close") >= F.col("ema"))).alias("side_above"),
        F.count_if(side & (F.col("close") < F.col("ema"))).alias("side_below"),
        F.count_if(pairs & rises).alias("side_rising"),
        F.count_if(pairs & falls).alias("side_falling"),
        F.count_if((back <= 3) & F.col("failed")).alias("failures"),
        F.sum(F.when(near, high_pivot.cast("int") + low_pivot.cast("int"))).alias("near_pivots"),
        F.sum("turns").alias("turns"),
        F.count_if(near & (F.col("close") > F.col("ema"))).alias("bars_above"),
        F.coalesce(F.min(F.when(F.col("low") <= F.col("ema"), back)) - 1, F.max(back)).alias("since_touch"),
        _among(back.between(2, LOOKBACK + 1), "high").alias("prior_high20"),
        # Pullback.
        F.max(start).alias("start_back"),
        _among(back <= start, "low", F.min).alias("swing_low"),
        F.count_if((back < start) & F.col("up") & F.col("near_high") & (F.col("high") >= F.col("p_high")) & ~F.col("outside")).alias("attempts"),
        (F.min(F.when((back >= start) & ~rises, back)) - F.max(start) + 1).alias("micro_before"),
        F.max((back <= start) & (F.col("low") <= F.col("ema") + 0.25 * F.col("size20"))).alias("touched_ema"),
        F.coalesce(
            F.max_by("low", F.when(low_cut & (cut_move >= 2 * F.col("size21")), F.col("idx"))),
            F.max_by("low", F.when(low_cut, F.col("idx"))),
            _among(back.between(2, LOOKBACK + 1), "low", F.min),
        ).alias("major_low"),
        # The last three low pivots.
        *[_among(F.col("low_back") == k, c).alias(f"{name}{k}") for k in (1, 2, 3) for c, name in (("low", "pivot"), ("idx", "pivot_at"))],
        # Last pivots, major ones first.
        F.coalesce(F.max_by("high", F.when(high_pivot & (high_move >= 2 * F.col("size20")), F.col("idx"))), F.max_by("high", F.when(high_pivot, F.col("idx"))), _among(near, "high")).alias("recent_high"),
        F.coalesce(F.max_by("low", F.when(low_pivot & (low_move >= 2 * F.col("size20")), F.col("idx"))), F.max_by("low", F.when(low_pivot, F.col("idx"))), _among(near, "low", F.min)).alias("recent_low"),
        # Reversal.
        _among(back <= 3, "high").alias("high3"),
        _among(back.between(4, 8), "high").alias("high4_8"),
        _among(back.between(6, LOOKBACK), "high").alias("high6_20"),
        _among(back <= 10, "high").alias("high10"),
    )


def context(symbols: DataFrame) -> DataFrame:
    """facts() with range_position, in_middle, confusion, disappointment, two_legs, always_in, state and the phase's columns."""
    col = F.col
    spread = F.greatest(col("high20") - col("low20"), F.lit(TINY))
    long = (col("side_bull") >= col("side_bear") + 2) & (col("side_above") >= SIDE_BARS - 2) & (col("side_rising") >= SIDE_BARS // 2)
    short = (col("side_bear") >= col("side_bull") + 2) & (col("side_below") >= SIDE_BARS - 2) & (col("side_falling") >= SIDE_BARS // 2)
    out = symbols.withColumns(
        {
            "range_position": (col("close") - col("low20")) / spread,
            "confusion": (col("tr_bars") >= 9) | (col("overlap_count") >= 10) | (col("inside_count") >= 4) | (col("heavy_tails") >= 9) | (F.abs(col("bull_bars") - col("bear_bars")) <= 2),
            "disappointment": col("failures") >= 2,
            "two_legs": (col("near_pivots") >= 3) & (col("turns") >= 2),
            "always_in": F.when(long, F.lit("long")).when(short, F.lit("short")).otherwise(F.lit("neutral")),
            "ext_pct": col("close") / F.greatest(col("ema"), F.lit(TINY)) - 1.0,
            "ext_r": (col("close") - col("ema")) / F.greatest(col("avg_range"), F.lit(TINY)),
            "size": F.greatest(col("high") - col("low"), F.lit(TINY)),
        }
    ).withColumn("in_middle", col("range_position").between(*RANGE_MIDDLE))
    calm = col("overlap_count") <= 8
    bull = (col("close") > col("ema")) & (col("ema") >= col("ema6")) & (col("bull_bars") >= col("bear_bars") + 3) & (col("bull_micro") >= 3) & calm
    bear = (col("close") < col("ema")) & (col("ema") <= col("ema6")) & (col("bear_bars") >= col("bull_bars") + 3) & (col("bear_micro") >= 3) & calm
    # Confusion alone doesn't overrule a strong side; the other three do.
    unclear = col("disappointment") | col("two_legs") | col("in_middle")

    def beyond(pct: float, r: float, touch: int) -> Column:
        return (col("ext_pct") >= pct) | (col("ext_r") >= r) | (col("since_touch") >= touch)

    big = (col("close") > col("open")) & (F.abs(col("close") - col("open")) / col("size") >= STRONG_BODY) & (col("size") >= col("avg_range") * BIG_RANGE) & col("near_high")
    climax_bar = big & (col("high") >= col("high20")) & beyond(*LATE[:3])
    climax = climax_bar & (beyond(*CLIMAX[:3]) | (col("bars_above") >= CLIMAX[3]))
    late = beyond(*LATE[:3]) | (col("bars_above") >= LATE[3]) | climax_bar
    middle = (col("ext_pct") >= MIDDLE[0]) | (col("ext_r") >= MIDDLE[1]) | (col("bars_above") >= MIDDLE[2])
    return out.withColumns(
        {
            "state": F.when(~unclear & bull, F.lit("bull_trend")).when(~unclear & bear, F.lit("bear_trend")).otherwise(F.lit("trading_range")),
            "phase": F.when(climax, F.lit("climax_bull")).when(late, F.lit("late_bull")).when(middle, F.lit("middle_bull")).otherwise(F.lit("early_bull")),
        }
    )


def _rising_pair() -> Column:
    """The last two bars both close above their open, the last not below the one before."""
    col = F.col
    return (col("close") > col("open")) & (col("prev_close") > col("p_open")) & (col("close") >= col("prev_close"))


def breakout(symbols: DataFrame) -> DataFrame:
    """symbols with the last bar's breakout above the twenty before: b_found, b_follows, b_entry, b_stop, b_target."""
    col = F.col
    body = F.abs(col("close") - col("open"))
    strong = (col("close") > col("open")) & (body >= F.greatest(col("avg_body") * 1.2, F.greatest(col("high") - col("low"), F.lit(TINY)) * STRONG_BODY)) & col("near_high") & (col("close") > col("ema"))
    return symbols.withColumns(
        {
            "b_found": ((col("high") > col("prior_high20")) | (col("close") > col("prior_high20"))) & strong,
            "b_follows": _rising_pair(),
            "b_entry": F.greatest("high", "prior_high20"),
            "b_stop": F.least("low", "p_low", "prior_high20"),
            "b_target": col("prior_high20") + col("high20") - col("low20"),
        }
    )


def wedges(symbols: DataFrame) -> DataFrame:
    """symbols with bull_flag and wedge_bottom: three low pivots apart from one another, falling or close together."""
    col = F.col
    apart = (col("pivot_at1") - col("pivot_at2") >= 2) & (col("pivot_at2") - col("pivot_at3") >= 2)
    close = F.greatest("pivot1", "pivot2", "pivot3") - F.least("pivot1", "pivot2", "pivot3") <= 3.0 * col("avg_range")
    falling = (col("pivot3") >= col("pivot2")) & (col("pivot2") >= col("pivot1"))
    three = col("pivot3").isNotNull()
    return symbols.withColumns({"bull_flag": F.coalesce(three & apart & (falling | close), F.lit(False)), "wedge_bottom": F.coalesce(three & apart & close, F.lit(False))})


# Names of the pullback's patterns.
PULLBACKS = {"wedge": "楔形牛旗 / 三推回调", "second": "H2 / 二次顺势恢复", "first": "首次回调 / H1 候选", "plain": "普通回调"}


def pullback(symbols: DataFrame) -> DataFrame:
    """symbols (with wedges) and the pullback that ends at the last bar: u_name, u_ready, u_follows, u_entry, u_stop."""
    col = F.col
    before = F.when(col("bars_count") - col("start_back") >= 2, col("micro_before")).otherwise(F.lit(1))
    first = (before >= 3) & (col("start_back") - 1 <= 10) & (col("attempts") <= 1)
    kind = F.when(col("bull_flag"), F.lit("wedge")).when(col("attempts") >= 2, F.lit("second")).when(first, F.lit("first")).otherwise(F.lit("plain"))
    signal = (col("close") > col("open")) & col("near_high") & (col("high") >= col("p_high"))
    held = col("swing_low") >= col("major_low") - 0.3 * col("avg_range")
    return symbols.withColumns(
        {
            "u_kind": kind,
            "u_held": held,
            "u_ready": signal & held,
            "u_follows": _rising_pair(),
            "u_entry": F.greatest("high", "p_high"),
            "u_stop": F.least("swing_low", "major_low"),
        }
    )


def reversal(symbols: DataFrame) -> DataFrame:
    """symbols (with wedges) and the major reversal at the last bar: r_found, r_ready, r_double, r_follows, r_entry, r_stop, r_target."""
    col = F.col
    bearish = (col("bear_bars") >= col("bull_bars")) & (col("close6") < col("ema6"))
    broke = (col("close") > col("ema")) & (col("high3") > col("high4_8"))
    double = F.coalesce(F.abs(col("pivot2") - col("pivot1")) <= 0.8 * col("avg_range"), F.lit(False))
    out = symbols.withColumns({"r_double": double, "r_found": bearish & broke & (double | col("wedge_bottom"))})
    strong = (col("close") > col("open")) & (col("close") - col("open") >= 0.5 * F.greatest(col("high") - col("low"), F.lit(TINY))) & col("near_high")
    follows = ((col("close") > col("open")) & (col("prev_close") > col("p_open"))) | (col("close") > col("p_high"))
    return out.withColumns(
        {
            "r_follows": follows,
            "r_ready": col("r_found") & strong & follows,
            "r_entry": F.greatest("high", "p_high"),
            "r_stop": F.coalesce(F.when(col("pivot2").isNotNull(), F.least("pivot1", "pivot2")), col("low20")),
            "r_target": F.when(col("bars_count") >= 25, col("high6_20")).otherwise(col("high10")),
        }
    )


def structures(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Everything above for every symbol of bars: one frame, one fold, one row per symbol (or other series named by)."""
    return reversal(pullback(wedges(breakout(context(facts(frame(bars, by), by))))))


def signal_text(avg_range: str) -> Column:
    """A last bar in words: size against avg_range, direction, shape against the bar before, place of its close."""
    col = F.col
    size = F.when(col("range") >= F.greatest(col(avg_range) * 1.2, F.lit(TINY)), F.lit("大")).otherwise(F.lit("普通"))
    way = F.when(col("close") >= col("open"), F.lit("阳线")).otherwise(F.lit("阴线"))
    shape = F.when(col("inside"), F.lit("孕线")).when(col("outside"), F.lit("吞噬线")).otherwise(F.lit("普通结构"))
    place = F.when(col("near_high"), F.lit("收近高点")).when(col("near_low"), F.lit("收近低点")).otherwise(F.lit("收盘居中"))
    return F.concat(size, way, F.lit("，"), shape, F.lit("，"), place)


def passes_traders_equation(entry: Column, stop: Column, target: Column, probability: Column) -> Column:
    risk, reward = F.greatest(entry - stop, F.lit(TINY)), F.greatest(target - entry, F.lit(0.0))
    return (reward > 0) & (probability * reward > (1.0 - probability) * risk)
