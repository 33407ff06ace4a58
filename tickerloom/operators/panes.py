"""Sector views of every full hour from partial sums, so that each news row is read once.

A pane is an hour of a sector's news of one score: how many they are, their weights as of the hour's beginning, and the
newest. News of the very second an hour begins are a pane of their own, because a window of 72 hours holds both of its
ends. The half-life depends on the score alone, so a pane's weight at a later hour is its weight times one power, and sums
over panes move forward exactly. News under 18 hours old do not decay; they are counted apart.

Panes of disjoint rows add up, so those of new rows are merged into those stored. Their number is bounded by sectors,
scores and hours, however many news there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.sectors import FRESH_H, LN2, WINDOW_S, clamped, clean, half_life, heat_formulas, preference_formulas, ranked, strength, trimmed_sectors
from tickerloom.sources.scratch import scratch_table

HOUR_S = 3600
WINDOW_H = WINDOW_S // HOUR_S
#: Hours of a stretch over which sums run; stretches are independent, as each starts with the window before it.
STRETCH_H = 28 * 24

PANES_SCHEMA = "sector string, score double, hour bigint, on_hour boolean, n bigint, score_sum bigint, weight double, heat_weight double, newest bigint"
_KEYS = ["sector", "score", "hour", "on_hour"]


def panes(news: DataFrame) -> DataFrame:
    """Panes of the rankings, by score, and of the summary, whose score is null; hours are counted from the epoch."""
    ts = F.col("publish_ts")
    hour = F.floor(ts / HOUR_S).cast("bigint")
    past = (ts - F.col("hour") * HOUR_S) / float(HOUR_S)
    timed = news.where(ts.isNotNull()).withColumn("hour", hour).withColumn("on_hour", F.col("hour") * HOUR_S == ts)
    told = timed.select("hour", "on_hour", ts, clamped(F.col("score")).alias("score"), past.alias("past"), F.explode(trimmed_sectors(F.col("sectors"))).alias("sector"))
    rank = told.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(0).cast("bigint").alias("score_sum"),
        F.sum(F.exp(LN2 * F.col("past") / half_life(F.col("score")))).alias("weight"),
        F.sum(F.exp(LN2 * F.col("past") / FRESH_H)).alias("heat_weight"),
        F.max("publish_ts").alias("newest"),
    )
    plain = timed.select("hour", "on_hour", ts, F.coalesce("score", F.lit(0)).cast("bigint").alias("points"), F.explode(F.array_distinct("sectors")).alias("sector"))
    plain = plain.withColumns({"sector": clean(F.col("sector")), "score": F.lit(None).cast("double")}).where("sector <> ''")
    zero = F.lit(0.0)
    summary = plain.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("score_sum"), zero.alias("weight"), zero.alias("heat_weight"), F.max("publish_ts").alias("newest"))
    return rank.unionByName(summary)


def merged_panes(*parts: DataFrame) -> DataFrame:
    """The panes of all rows of which parts are the panes."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    sums = [F.sum(c).alias(c) for c in ("n", "score_sum", "weight", "heat_weight")]
    return out.groupBy(*_KEYS).agg(*sums, F.max("newest").alias("newest"))


def _moved(by_hours: Column, half: Column | float) -> Column:
    return F.exp(LN2 * by_hours / half)


def states(parts: DataFrame, first: int, last: int) -> DataFrame:
    """sector, score and hour (as a window's end, first to last) of every score with news in the window, with their number
    n, the number fresh, the weights old and heat_old of those that are not, score_sum and newest.

    Running sums over the hours of a sector and score; what leaves a window is the sum as it was a window ago.
    """
    before = WINDOW_H + 1
    stretch = F.floor(F.col("hour") / STRETCH_H)
    ends = F.floor((F.col("hour") + before) / STRETCH_H)
    near = parts.where(F.col("hour").between(first - before, last))
    spread = near.withColumn("stretch", F.explode(F.sequence(stretch, ends)))
    start = F.col("stretch") * STRETCH_H
    half = half_life(F.coalesce("score", F.lit(0.0)))
    scaled = F.col("hour") - start
    at = lambda flag, c: F.when(F.col("on_hour") == flag, F.col(c))
    sums = spread.groupBy("sector", "score", "stretch", "hour").agg(
        F.sum(at(True, "n")).alias("n_on"),
        F.sum(at(False, "n")).alias("n_in"),
        F.sum(at(True, "score_sum")).alias("s_on"),
        F.sum(at(False, "score_sum")).alias("s_in"),
        F.sum("weight").alias("w"),
        F.sum("heat_weight").alias("h"),
        F.max(at(True, "newest")).alias("t_on"),
        F.max(at(False, "newest")).alias("t_in"),
    )
    sums = scratch_table(sums.withColumns({"w": F.col("w") * _moved(scaled, half), "h": F.col("h") * _moved(scaled, FRESH_H)}))
    # Every hour of a stretch from its first pane on, until the last one has left the window.
    spans = sums.groupBy("sector", "score", "stretch").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    reach = F.least(F.col("hi") + before, start + STRETCH_H - 1, F.lit(last))
    every = spans.where(reach >= F.col("lo")).select("sector", "score", "stretch", F.explode(F.sequence(F.col("lo"), reach)).alias("hour"))
    # Null-safe on score: the summary's is null.
    key = [F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("sector", "score", "stretch", "hour")]
    grid = every.alias("g").join(sums.alias("p"), key, "left").select("g.*", *[F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in ("n_on", "n_in", "s_on", "s_in", "w", "h")], "p.t_on", "p.t_in")
    order = Window.partitionBy("sector", "score", "stretch").orderBy("hour")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = grid.withColumns({c: F.sum(c).over(run) for c in ("n_on", "n_in", "s_on", "s_in", "w", "h")} | {c: F.max(c).over(run) for c in ("t_on", "t_in")})
    lag = lambda c, k: F.lag(c, k, 0).over(order)
    fresh_h = int(FRESH_H)
    inside = lambda on, within, k: F.col(on) - lag(on, k) + lag(within, 1) - lag(within, k)
    now = F.col("hour") - FRESH_H - start
    out = running.select(
        "sector",
        "score",
        "hour",
        "stretch",
        inside("n_on", "n_in", before).alias("n"),
        inside("n_on", "n_in", fresh_h + 1).alias("fresh"),
        inside("s_on", "s_in", before).alias("score_sum"),
        ((lag("w", fresh_h + 1) - lag("w", before)) * _moved(-now, half)).alias("old"),
        ((lag("h", fresh_h + 1) - lag("h", before)) * _moved(-now, FRESH_H)).alias("heat_old"),
        F.greatest("t_on", F.lag("t_in", 1).over(order)).alias("newest"),
    )
    return out.where((F.col("n") > 0) & (F.col("hour") >= first) & (F.floor(F.col("hour") / STRETCH_H) == F.col("stretch"))).drop("stretch")


def hourly_preference(of: DataFrame) -> DataFrame:
    """hour and the investment-preference ranking at it, of states."""
    score = F.col("score")
    decayed = F.col("fresh") + F.col("old")
    age = F.col("hour") - F.col("newest") / float(HOUR_S)
    newest = F.when(age > FRESH_H, F.exp(-LN2 * (age - FRESH_H) / half_life(score))).otherwise(F.lit(1.0))
    force = F.abs(strength(score)) / 100.0 * newest
    zero = F.lit(0.0)
    sums = of.where(score.isNotNull()).groupBy("hour", "sector").agg(
        F.sum("n").alias("news_count"),
        F.coalesce(F.sum(F.when(score > 0, F.col("n"))), F.lit(0)).alias("positive_count"),
        F.coalesce(F.sum(F.when(score < 0, F.col("n"))), F.lit(0)).alias("negative_count"),
        F.coalesce(F.sum(F.when(score == 0, F.col("n"))), F.lit(0)).alias("neutral_count"),
        F.sum(decayed).alias("e"),
        F.sum(strength(score) * decayed).alias("effects"),
        F.coalesce(F.sum(F.when(score >= 20, decayed)), zero).alias("p"),
        F.coalesce(F.sum(F.when(score <= -20, decayed)), zero).alias("n"),
        F.coalesce(F.max(F.when(score > 0, force)), zero).alias("up"),
        F.coalesce(F.max(F.when(score < 0, force)), zero).alias("down"),
        F.max("newest").alias("latest_ts"),
        F.max(F.when(score > 0, score)).alias("top_positive"),
        F.min(F.when(score < 0, score)).alias("top_negative"),
    )
    return ranked(preference_formulas(sums), "preference", ["hour"])


def hourly_heat(of: DataFrame) -> DataFrame:
    """hour and the market-heat ranking at it, of states."""
    sums = of.where(F.col("score").isNotNull()).groupBy("hour", "sector").agg(
        F.sum("n").alias("news_count"), F.sum(F.col("fresh") + F.col("heat_old")).alias("effective_news_count"), F.sum("fresh").alias("recent_count"), F.max("newest").alias("latest_ts")
    )
    return ranked(heat_formulas(sums), "heat", ["hour"])


def hourly_summary(of: DataFrame) -> DataFrame:
    """hour, sector, news_count and score_sum of the three days before it, of states."""
    return of.where(F.col("score").isNull()).select("hour", "sector", F.col("n").alias("news_count"), "score_sum")


def hourly_views(parts: DataFrame, first: int, last: int) -> DataFrame:
    """The three views at every full hour from first to last as one table: hour, view, sector, rank, news_count, score."""
    of = scratch_table(states(parts, first, last))
    row = lambda view, df, rank, score: df.select("hour", F.lit(view).alias("view"), "sector", rank.cast("int").alias("rank"), F.col("news_count").cast("bigint").alias("news_count"), score.cast("double").alias("score"))
    out = row("summary", hourly_summary(of), F.lit(None), F.col("score_sum"))
    for view, df in (("preference", hourly_preference(of)), ("heat", hourly_heat(of))):
        out = out.unionByName(row(view, df, F.col("rank"), F.round("final_score", 2)))
    return out
