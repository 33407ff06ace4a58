"""Buy-point decisions over price-action structures: setups, the decision and its texts, the daily batch, the market scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.newstext import fixed, fmt_num
from tickerloom.operators import price_action as P
from tickerloom.operators.bars import MIN_BARS, TINY, bar_faults, claim_plan, recent_bars, valid_bars
from tickerloom.sources.scratch import scratch_table

BUY, NOT_BUY = "买", "不买"

# The sentences of decisions.
CHANNELS = {
    "trading_range": ("震荡区间 / 双向交易环境", "否，除非在下沿附近出现高质量反转"),
    "bull_trend": ("多头趋势 / 偏单边上涨", "是，优先顺势做多"),
    "bear_trend": ("空头趋势 / 偏单边下跌", "否，除非形成大反转"),
}
CLIMAX = {
    "pattern": "多头高潮 / 远离EMA20的大阳线",
    "entry": "等待回调到 EMA20 附近，或等待高潮后形成新的震荡区间下沿再评估。",
    "trigger": "至少等待价格回踩 EMA20、形成二次买点，或从高潮转为区间后在下沿出现反转信号。",
    "reason": "当前虽然处于多头背景，但价格明显远离 EMA20，并出现末端大阳线/创新高结构，更接近多头高潮而不是低风险买点。",
}
MIDDLE = {
    "pattern": "震荡区间中部",
    "entry": "等待接近区间下沿的反转做多，或等待区间真正向上突破并出现跟随。",
    "trigger": "边缘反转或明确突破+跟随确认后再考虑突破单。",
    "reason": "当前处于震荡区间中部。站点逻辑要求区间中部避免追单，优先等待边缘位置。",
}
NOTHING = {
    "pattern": "未形成允许的买点结构",
    "entry": "等待更清晰的趋势背景、边缘位置或确认后的突破单机会",
    "trigger": "必须先满足正期望值、明确方向门和有效入场信号",
}
SHORT_SIDE = "当前处于单边下跌 / 空头优势背景。按 Always In 逻辑，不应主动寻找普通做多。"
TREND_NOT = {
    "background": "不满足顺势做多背景。",
    "late": "当前处于多头趋势后期，且回调没有有效接近 EMA20；禁止把远离均线的强阳线当作低风险回调买点。",
    "range": "当前回调已演变为震荡区间/TBTL，不按简单顺势回调处理。",
    "signal": "顺势回调背景存在，但最后一根尚未形成合格的做多信号K。",
}
BREAKOUT_NOT = {
    "late": "当前处于多头趋势后期/高潮阶段，禁止追涨突破，等待回调到 EMA20 附近或重新形成低风险结构。",
    "none": "当前未形成强势突破结构。",
    "middle": "区间中部的突破信号不交易，优先等待边缘突破+跟随。",
}
REVERSAL_NOT = {"none": "当前未形成大反转候选。", "signal": "大反转候选存在，但信号K或触发条件尚未完成。"}
WHY = {
    "trend": "当前处于趋势背景，且信号来自顺势回调后的突破单入场，符合站点对 H1/H2/牛旗/楔形牛旗的处理方式。",
    "breakout": "当前价格以趋势K线突破关键阻力，并具备跟随确认或强势单边背景，符合站点对突破的处理逻辑。",
    "reversal": "当前满足大反转的关键条件：先有趋势线/均线破坏，再有原趋势恢复失败，并出现高盈亏比的突破单信号。",
}
TYPES = {"trend": "是，属于趋势中的回调买点", "breakout": "是，属于有效突破后的买点", "reversal": "是，属于强反转买点"}
PATTERNS = {"breakout": "有效向上突破", "double": "双底 / 大反转买点", "wedge": "楔形底 / 大反转买点"}
EQUATION = ("按交易者方程估算，该交易的潜在利润相对风险具备正期望值。", "该交易未通过交易者方程：盈亏空间不足以覆盖结构概率。")
TOO_FEW, BAD_HIGH, BAD_LOW = "bars 至少需要 30 根，建议 90 根", "high_price 必须不小于 open/close/low", "low_price 必须不大于 open/close/high"

FIELDS = (
    "conclusion",
    "current_channel",
    "channel_support_buy",
    "current_pattern",
    "pattern_allowed_type",
    "key_candle",
    "has_follow_through",
    "can_trigger_buy",
    "expected_entry",
    "trigger_condition",
    "buy_price",
    "stop_loss",
    "take_profit",
    "reason",
)


def _named(key: Column, names: dict[str, str]) -> Column:
    pairs = list(names.items())
    out = F.when(key == pairs[0][0], F.lit(pairs[0][1]))
    for k, v in pairs[1:]:
        out = out.when(key == k, F.lit(v))
    return out


def _yes(condition: Column) -> Column:
    return F.when(condition, F.lit("是")).otherwise(F.lit("否"))


def setups(found: DataFrame) -> DataFrame:
    """found (structures()) with trend_not, breakout_not and reversal_not (null where that setup qualifies), and the setup
    chosen of those that do, in that order: setup, entry, stop, target, probability."""
    col = F.col
    middle = (col("state") == "trading_range") & col("in_middle")
    late = col("phase").isin("late_bull", "climax_bull")
    out = found.withColumns(
        {
            "trend_not": F.when((col("state") != "bull_trend") | (col("always_in") == "short"), F.lit("background"))
            .when((col("phase") == "late_bull") & ~col("touched_ema"), F.lit("late"))
            .when(col("two_legs"), F.lit("range"))
            .when(~col("u_ready"), F.lit("signal")),
            "breakout_not": F.when(late, F.lit("late")).when(~col("b_found"), F.lit("none")).when(middle, F.lit("middle")),
            "reversal_not": F.when(~col("r_found"), F.lit("none")).when(~col("r_ready"), F.lit("signal")),
        }
    )
    setup = F.when(col("trend_not").isNull(), F.lit("trend")).when(col("breakout_not").isNull(), F.lit("breakout")).when(col("reversal_not").isNull(), F.lit("reversal"))
    # What rules before any setup is looked at.
    out = out.withColumn("hold", F.when((col("state") == "bull_trend") & (col("phase") == "climax_bull"), F.lit("climax")).when(middle, F.lit("middle")))
    out = out.withColumn("setup", F.when(col("hold").isNull(), setup))

    def of(trend: Column, breakout: Column, reversal: Column) -> Column:
        return F.when(col("setup") == "trend", trend).when(col("setup") == "breakout", breakout).when(col("setup") == "reversal", reversal)

    out = out.withColumns({"entry": of(col("u_entry"), col("b_entry"), col("r_entry")), "stop": of(col("u_stop"), col("b_stop"), col("r_stop"))})
    risk = F.greatest(col("entry") - col("stop"), F.lit(TINY))
    chance = F.when(col("u_kind") == "first", 0.58).when(col("u_kind") == "second", 0.55).otherwise(0.52)
    return out.withColumns(
        {
            "target": of(
                F.greatest(col("high20"), col("entry") + 2.0 * risk),
                F.greatest(col("recent_high"), col("b_target"), col("entry") + 1.8 * risk),
                F.greatest(col("recent_high"), col("r_target"), col("entry") + 2.0 * risk),
            ),
            "probability": of(chance, F.when(col("state") == "bull_trend", 0.56).otherwise(0.50), F.lit(0.40)),
        }
    )


def summary_text() -> Column:
    """A symbol's background in words."""
    col = F.col
    state = _named(col("state"), {"bull_trend": "多头趋势", "bear_trend": "空头趋势", "trading_range": "震荡区间"})
    return F.concat(
        F.lit("背景判断：当前更接近"), state, F.lit("；Always In 状态为 "), col("always_in"), F.lit("；近20根 bull/bear/tr="),
        F.concat_ws("/", *[col(c).cast("string") for c in ("bull_bars", "bear_bars", "tr_bars")]),
        F.lit("，重叠数="), col("overlap_count").cast("string"), F.lit("，TBTL="), _yes(col("two_legs")),
        F.lit("；多头阶段="), col("phase"), F.lit("，EMA乖离="), fixed(col("ext_pct") * 100, 2), F.lit("%/"), fixed(col("ext_r"), 2), F.lit("R。"),
    )


def decisions(found: DataFrame) -> DataFrame:
    """symbol, FIELDS, setup, entry, stop, target and probability of every row of setups()."""
    col = F.col
    rows = found.withColumns({"last_bar": P.signal_text("avg_range10"), "summary": summary_text()})
    passed = col("setup").isNotNull() & P.passes_traders_equation(col("entry"), col("stop"), col("target"), col("probability"))
    rows = rows.withColumn("buys", passed)

    def by_hold(key: str, otherwise: Column) -> Column:
        return F.when(col("hold") == "climax", F.lit(CLIMAX[key])).when(col("hold") == "middle", F.lit(MIDDLE[key])).otherwise(otherwise)

    some = col("setup").isNotNull()
    pattern = (
        F.when(col("setup") == "trend", _named(col("u_kind"), P.PULLBACKS))
        .when(col("setup") == "breakout", F.lit(PATTERNS["breakout"]))
        .when(col("setup") == "reversal", F.when(col("r_double"), F.lit(PATTERNS["double"])).otherwise(F.lit(PATTERNS["wedge"])))
        .otherwise(F.lit(NOTHING["pattern"]))
    )
    candle = F.when(col("setup") == "trend", P.signal_text("avg_range")).when(col("setup") == "breakout", F.concat(col("last_bar"), F.lit("，并突破 "), fmt_num(col("prior_high20")))).otherwise(col("last_bar"))
    follows = F.when(col("setup") == "trend", col("u_follows")).when(col("setup") == "breakout", col("b_follows")).when(col("setup") == "reversal", col("r_follows")).otherwise(F.lit(False))
    short = F.when((col("always_in") == "short") & (col("state") != "trading_range"), F.lit(SHORT_SIDE))
    no_setup = [_named(col("trend_not"), TREND_NOT), _named(col("breakout_not"), BREAKOUT_NOT), _named(col("reversal_not"), REVERSAL_NOT)]
    reason = F.when(col("buys"), F.concat_ws(" ", short, col("summary"), _named(col("setup"), WHY), F.lit(EQUATION[0]))).when(some, F.concat_ws(" ", short, col("summary"), F.lit(EQUATION[1]))).otherwise(F.concat_ws(" ", short, col("summary"), *no_setup))
    waits = lambda key: by_hold(key, F.when(~some, F.lit(NOTHING[key])))
    return rows.select(
        "symbol",
        F.when(col("buys"), F.lit(BUY)).otherwise(F.lit(NOT_BUY)).alias("conclusion"),
        _named(col("state"), {k: v[0] for k, v in CHANNELS.items()}).alias("current_channel"),
        _named(col("state"), {k: v[1] for k, v in CHANNELS.items()}).alias("channel_support_buy"),
        by_hold("pattern", pattern).alias("current_pattern"),
        F.coalesce(_named(col("setup"), TYPES), F.lit("否")).alias("pattern_allowed_type"),
        candle.alias("key_candle"),
        _yes(follows).alias("has_follow_through"),
        _yes(col("buys")).alias("can_trigger_buy"),
        F.when(~col("buys"), waits("entry")).alias("expected_entry"),
        F.when(~col("buys"), waits("trigger")).alias("trigger_condition"),
        F.when(col("buys"), F.concat(F.lit("突破 "), fmt_num(col("entry")), F.lit(" 上方的突破单入场"))).alias("buy_price"),
        F.when(col("buys"), F.concat(fmt_num(col("stop")), F.lit(" 下方（保护性止损 / 结构失效位）"))).alias("stop_loss"),
        F.when(col("buys"), F.concat(F.lit("先看 "), fmt_num(col("target")), F.lit("；若继续单边，可移动保护止损管理盈利"))).alias("take_profit"),
        by_hold("reason", reason).alias("reason"),
        "setup",
        "entry",
        "stop",
        "target",
        "probability",
    )


def analysed(bars: DataFrame) -> DataFrame:
    """The decision for every symbol of bars with MIN_BARS bars or more."""
    return decisions(setups(P.structures(bars).where(F.col("bars_count") >= MIN_BARS)))


def chart_text(bars: DataFrame) -> DataFrame:
    """symbol and chart, a text of lines: background, candidates and the last five bars."""
    col = F.col
    rows = P.frame(bars)
    found = setups(P.reversal(P.pullback(P.wedges(P.breakout(P.context(P.facts(rows)))))))
    line = F.concat(F.lit("- "), col("trade_date").cast("string"), F.lit(": O="), fmt_num(col("open")), F.lit(", H="), fmt_num(col("high")), F.lit(", L="), fmt_num(col("low")), F.lit(", C="), fmt_num(col("close")))
    last = rows.where("back <= 5").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("trade_date", line.alias("line")))).alias("bars"))  # five each
    text = F.concat_ws(
        "\n",
        F.lit("以下是按 Price Action 规则整理后的结构化上下文，只能基于这些价格行为做判断。\n"),
        F.lit("一、背景与市场状态："),
        F.concat(F.lit("- 市场状态："), col("state")),
        F.concat(F.lit("- Always In："), col("always_in")),
        F.concat(F.lit("- 近20根 bull/bear/tr："), F.concat_ws("/", *[col(c).cast("string") for c in ("bull_bars", "bear_bars", "tr_bars")])),
        F.concat(F.lit("- 重叠K线数："), col("overlap_count").cast("string")),
        F.concat(F.lit("- 区间位置："), fixed(col("range_position"), 2)),
        F.concat(F.lit("- 多头阶段："), col("phase")),
        F.concat(F.lit("- EMA20乖离："), fixed(col("ext_pct") * 100, 2), F.lit("% / "), fixed(col("ext_r"), 2), F.lit("R")),
        F.concat(F.lit("- 距上次触碰EMA20："), col("since_touch").cast("string"), F.lit("根")),
        F.concat(F.lit("- 复杂调整/TBTL："), _yes(col("two_legs")), F.lit("\n")),
        F.lit("二、候选形态："),
        F.concat(F.lit("- 回调候选："), _named(col("u_kind"), P.PULLBACKS), F.lit(" / signal_ready="), _yes(col("u_ready"))),
        F.concat(F.lit("- 突破候选："), _yes(col("b_found")), F.lit(" / 跟随="), _yes(col("b_follows"))),
        F.concat(F.lit("- 大反转候选："), _yes(col("r_found")), F.lit(" / signal_ready="), _yes(col("r_ready")), F.lit("\n")),
        F.lit("三、最近5根K线明细："),
        F.array_join(F.transform("bars", lambda b: b["line"]), "\n"),
    )
    return found.join(last, "symbol").select("symbol", text.alias("chart"))


def markdown(decided: DataFrame) -> DataFrame:
    """decided with formatted_markdown, the decision as headed lists."""
    col = F.col
    item = lambda name, c: F.concat(F.lit(f"- {name}："), F.coalesce(col(c), F.lit("None")))
    head = [
        F.lit("# 是否是买点"), item("结论", "conclusion"), F.lit("\n# 通道情况"), item("当前通道", "current_channel"), item("是否支持买入", "channel_support_buy"),
        F.lit("\n# 形态学情况"), item("当前形态", "current_pattern"), item("是否属于允许的买点类型", "pattern_allowed_type"),
        F.lit("\n# 关键节点K线"), item("关键K线", "key_candle"), item("是否有 follow-through", "has_follow_through"), item("是否足以触发买点", "can_trigger_buy"),
        F.lit("\n# 执行结论"),
    ]
    buy = F.concat_ws("\n", item("买入位置", "buy_price"), item("止损位", "stop_loss"), item("卖出位", "take_profit"))
    wait = F.concat_ws("\n", item("预期买入位置", "expected_entry"), item("触发条件", "trigger_condition"))
    return decided.withColumn("formatted_markdown", F.concat_ws("\n", *head, F.when(col("conclusion") == BUY, buy).otherwise(wait), item("理由", "reason")))


def _bar_sets(bars: DataFrame) -> DataFrame:
    """symbol, bars_count, first and last date, current_price, recent_high and recent_low, input_bars, and fault: what is wrong
    with the first bar that contradicts itself. A symbol has as many bars here as the caller's limit lets through."""
    bar = F.struct("trade_date", "open", "high", "low", "close")
    top, bottom = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    fault = F.when(F.col("high") < top, F.lit(BAD_HIGH)).when(F.col("low") > bottom, F.lit(BAD_LOW))
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).cast("int").alias("bars_count"),
        F.min("trade_date").alias("kline_trade_date_start"),
        F.max("trade_date").alias("kline_trade_date_end"),
        F.max_by("close", "trade_date").alias("current_price"),
        F.max("high").alias("recent_high"),
        F.min("low").alias("recent_low"),
        F.array_sort(F.collect_list(bar)).alias("input_bars"),
        F.min_by(fault, F.when(fault.isNotNull(), F.col("trade_date"))).alias("fault"),
    )


def stock_tech_batch(pool: DataFrame, results: DataFrame, bars: DataFrame, end_date: str, least: int = 20) -> DataFrame:
    """A row per stock that a run claims: its pool columns, analysis_status, error_message, the bars' context and FIELDS.

    claim_plan says what is claimed; the last MIN_BARS bars up to end_date are analysed. Fewer than least valid bars are
    skipped_data_insufficient; a bar that contradicts itself, or fewer than MIN_BARS, fails with a message.
    """
    plan = claim_plan(pool, results)
    # Each is used several times and costs a row per claim, or MIN_BARS of them: written once.
    todo = scratch_table(plan.where(F.col("plan").isin("insert", "retry", "take_over")))
    last = scratch_table(recent_bars(bars, todo, end_date))
    sets = scratch_table(_bar_sets(last))
    sound = last.join(sets.where((F.col("bars_count") >= MIN_BARS) & F.col("fault").isNull()).select("symbol"), "symbol", "left_semi")
    decided = analysed(sound).select("symbol", *FIELDS)
    out = todo.join(sets.withColumnRenamed("symbol", "stock_code"), "stock_code", "left").join(decided.withColumnRenamed("symbol", "stock_code"), "stock_code", "left")
    n = F.coalesce("bars_count", F.lit(0))
    status = F.when(n < least, F.lit("skipped_data_insufficient")).when(F.col("conclusion").isNull(), F.lit("failed")).otherwise(F.lit("succeeded"))
    message = F.when(n < least, F.concat(F.lit(f"kline bars insufficient, need >={least}, got "), n.cast("string"))).when(F.col("conclusion").isNull(), F.coalesce("fault", F.lit(TOO_FEW)))
    own = ["sector", "sector_rank", "stock_rank", "stock_code", "stock_name", "plan"]
    context = ["kline_trade_date_start", "kline_trade_date_end", "current_price", "recent_high", "recent_low", "input_bars"]
    return out.select(*own, status.alias("analysis_status"), message.alias("error_message"), n.alias("bars_count"), *context, *FIELDS)


def market_scan(snapshot: DataFrame, history: DataFrame, today: str, previous: str, most_history: int = 89) -> DataFrame:
    """A row per snapshot row (symbol, name and its four prices): symbol, name, status, reason, bars_count, and FIELDS.

    Today's bar follows up to most_history bars until previous; the limit is taken before bars without a price go.
    """
    prices = ["open", "high", "low", "close"]
    whole = F.col("symbol").isNotNull() & (F.col("symbol") != "")
    for c in prices:
        whole = whole & F.col(c).isNotNull()
    marked = snapshot.withColumn("whole", whole)
    now = marked.where("whole").select("symbol", F.to_date(F.lit(today)).alias("trade_date"), *prices)
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    known = history.where(F.col("trade_date") <= F.to_date(F.lit(previous))).join(now.select("symbol"), "symbol", "left_semi")
    before = known.withColumn("place", place).where(F.col("place") <= most_history).select("symbol", "trade_date", *prices)
    # Used by the counts and by the analysis: most_history + 1 bars of a symbol, written once.
    rows = scratch_table(now.unionByName(valid_bars(before)))
    sets = scratch_table(_bar_sets(rows).select("symbol", "bars_count", "fault"))
    sound = rows.join(sets.where((F.col("bars_count") >= MIN_BARS) & F.col("fault").isNull()).select("symbol"), "symbol", "left_semi")
    decided = analysed(sound).select("symbol", *FIELDS)
    out = marked.select("symbol", "name", "whole").join(sets, "symbol", "left").join(decided, "symbol", "left")
    few = F.col("bars_count") < MIN_BARS
    status = F.when(~F.col("whole"), F.lit("skipped_invalid_current_snapshot")).when(few, F.lit("skipped_data_insufficient")).when(F.col("conclusion").isNull(), F.lit("failed")).otherwise(F.lit("succeeded"))
    got = F.concat(F.lit("need >=30 bars for strict Price Action context, got "), F.col("bars_count").cast("string"), F.lit(" (history="), (F.col("bars_count") - 1).cast("string"), F.lit(" + current=1); target is 90 bars when available"))
    why = F.when(~F.col("whole"), F.lit("current snapshot row missing OHLC fields")).when(few, got).when(F.col("conclusion").isNull(), F.col("fault"))
    return out.select("symbol", "name", status.alias("status"), why.alias("scan_reason"), F.when(F.col("whole"), F.col("bars_count")).alias("bars_count"), *FIELDS)


def scan_summary(scanned: DataFrame) -> DataFrame:
    """One row of counts by status, and of buys among the succeeded."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return scanned.agg(
        F.count(F.lit(1)).alias("total"),
        count("succeeded"),
        F.count_if(F.col("conclusion") == BUY).alias("buy"),
        F.count_if(F.col("conclusion") == NOT_BUY).alias("not_buy"),
        count("skipped_data_insufficient"),
        count("skipped_invalid_current_snapshot"),
        count("failed"),
    )


def write_report(scanned: DataFrame, path: str, buy_only: bool = False) -> None:
    """The scan's items as JSON lines in order of status and symbol, and their summary beside them."""
    items = scanned.where((F.col("status") != "succeeded") | (F.col("conclusion") == BUY)) if buy_only else scanned
    items.orderBy("status", "symbol").write.json(f"{path}/items")
    scan_summary(scanned).coalesce(1).write.json(f"{path}/summary")


def faulty(bars: DataFrame) -> DataFrame:
    """Bars that contradict themselves with what is wrong."""
    high = F.col("high") < F.greatest("open", "close", "low")
    return bar_faults(bars).withColumn("fault", F.when(high, F.lit(BAD_HIGH)).otherwise(F.lit(BAD_LOW)))
