"""Rolling sector views of scored news: the 3-day summary, the investment-preference and the market-heat ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking formulas.
WINDOW_S = 72 * 3600
FRESH_H = 18.0
LN2 = 0.6931471805599453


def clean(text: Column) -> Column:
    """Trimmed of Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def event_window(news: DataFrame, asof: Column | int, window_s: int = WINDOW_S) -> DataFrame:
    """Rows of the last window_s seconds, both ends included."""
    asof = F.lit(asof) if isinstance(asof, int) else asof
    return news.where(F.col("publish_ts").between(asof - window_s, asof))


def sector_summary(news: DataFrame, asof: Column | int) -> DataFrame:
    """sector, news_count, score_sum; sectors are made distinct before they are trimmed, so "A" and "A " count twice."""
    rows = event_window(news, asof).select("score", F.explode(F.array_distinct("sectors")).alias("sector"))
    rows = rows.withColumn("sector", clean(F.col("sector"))).where("sector <> ''")
    return rows.groupBy("sector").agg(F.count(F.lit(1)).alias("news_count"), F.sum(F.coalesce("score", F.lit(0))).alias("score_sum"))


def trimmed_sectors(sectors: Column) -> Column:
    """Distinct names after trimming, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(sectors, F.array().cast("array<string>")), clean), lambda s: s != ""))


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.coalesce(score.try_cast("double"), F.lit(0.0))))


def strength(score: Column) -> Column:
    s = F.abs(score) / 100.0
    return F.when(score == 0, F.lit(0.0)).otherwise(F.signum(score) * 100.0 * F.pow(s, 2.6 - 1.6 * s))


def half_life(score: Column) -> Column:
    """Hours in which news of this score lose half their weight, once they are not fresh."""
    return FRESH_H + FRESH_H * F.pow(F.abs(score) / 100.0, F.lit(1.5))


def aged_news(news: DataFrame, asof: Column | int) -> DataFrame:
    """News of the window with at least one sector, with score, age, both decays, strength and effect."""
    asof = F.lit(asof) if isinstance(asof, int) else asof
    age = F.greatest((asof - F.col("publish_ts")) / F.lit(3600.0), F.lit(0.0))
    old = F.col("age_h") > FRESH_H
    rows = event_window(news, asof).withColumn("sectors", trimmed_sectors(F.col("sectors"))).where(F.size("sectors") > 0)
    rows = rows.withColumns({"score": clamped(F.col("score")), "age_h": age})
    rows = rows.withColumns(
        {
            "strength": strength(F.col("score")),
            "decay": F.when(old, F.exp(-LN2 * (F.col("age_h") - FRESH_H) / half_life(F.col("score")))).otherwise(F.lit(1.0)),
            "heat_decay": F.when(old, F.exp(-LN2 * (F.col("age_h") - FRESH_H) / FRESH_H)).otherwise(F.lit(1.0)),
        }
    )
    return rows.withColumn("effect", F.col("strength") * F.col("decay"))


def dominant_events(aged: DataFrame, kind: str, by: list[str], n: int = 5) -> DataFrame:
    """by, dominant_events: a sector's strongest ("preference") or freshest ("heat") events; the cut precedes the collection."""
    rows = aged.select("*", F.explode("sectors").alias("sector"))
    keys = [F.abs("effect").desc(), F.col("publish_ts").desc(), "event_id"] if kind == "preference" else ["age_h", F.col("publish_ts").desc(), "event_id"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
    first = rows.withColumn("place", place).where(F.col("place") <= n)
    return first.groupBy(*by).agg(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_id"))), lambda x: x["event_id"])).alias("dominant_events"))


def preference_scores(aged: DataFrame, by: list[str]) -> DataFrame:
    """The signed, decay-weighted score of every sector (by: "sector", and what else separates rankings)."""
    rows = aged.select("*", F.explode("sectors").alias("sector"))
    score, decay = F.col("score"), F.col("decay")
    force = F.abs("strength") / 100.0 * decay
    zero = F.lit(0.0)
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("news_count"),
        F.count_if(score > 0).alias("positive_count"),
        F.count_if(score < 0).alias("negative_count"),
        F.count_if(score == 0).alias("neutral_count"),
        F.sum("decay").alias("e"),
        F.sum("effect").alias("effects"),
        F.coalesce(F.sum(F.when(score >= 20, decay)), zero).alias("p"),
        F.coalesce(F.sum(F.when(score <= -20, decay)), zero).alias("n"),
        F.coalesce(F.max(F.when(score > 0, force)), zero).alias("up"),
        F.coalesce(F.max(F.when(score < 0, force)), zero).alias("down"),
        F.max("publish_ts").alias("latest_ts"),
        F.max(F.when(score > 0, score)).alias("top_positive"),
        F.min(F.when(score < 0, score)).alias("top_negative"),
    )
    return preference_formulas(agg)


def preference_formulas(sums: DataFrame) -> DataFrame:
    """The scores of sums e, effects, p, n, up and down."""
    agg = sums.withColumns(
        {
            "event_score": 100.0 * F.tanh(F.col("effects") / F.sqrt(F.greatest(F.col("e"), F.lit(1.0))) / 60.0),
            "count_score": 100.0 * F.tanh((F.log(1.0 + F.col("p")) - F.log(1.0 + F.col("n"))) / 1.6),
            "time_score": 100.0 * (F.col("up") - F.col("down")),
        }
    )
    final = 0.75 * F.col("event_score") + 0.08 * F.col("count_score") + 0.17 * F.col("time_score")
    agg = agg.withColumn("final_score", F.greatest(F.lit(-100.0), F.least(F.lit(100.0), final)))
    return agg.drop("e", "effects", "p", "n", "up", "down")


def heat_scores(aged: DataFrame, by: list[str]) -> DataFrame:
    """Count and freshness of every sector's news, whatever its score."""
    rows = aged.select("*", F.explode("sectors").alias("sector"))
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("news_count"),
        F.sum("heat_decay").alias("effective_news_count"),
        F.count_if(F.col("age_h") <= FRESH_H).alias("recent_count"),
        F.max("publish_ts").alias("latest_ts"),
    )
    return heat_formulas(agg)


def heat_formulas(sums: DataFrame) -> DataFrame:
    """The scores of sums effective_news_count and news_count."""
    agg = sums.withColumns({"count_score": 100.0 * F.tanh(F.col("effective_news_count") / 6.0), "time_score": 100.0 * F.col("effective_news_count") / F.greatest(F.col("news_count"), F.lit(1))})
    final = 0.75 * F.col("count_score") + 0.25 * F.col("time_score")
    return agg.withColumn("final_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), final)))


def ranked(scores: DataFrame, kind: str, apart: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """scores with rank 1..n in order of scores rounded to two digits; apart: what separates rankings.

    A window over sectors of one ranking, which are few by construction; rows of news never meet in it.
    """
    r2 = lambda c: F.round(c, 2).desc()
    if kind == "preference":
        keys = [r2("final_score"), r2("event_score"), r2("count_score"), r2("time_score"), F.col("news_count").desc(), F.col("sector")]
    else:
        keys = [r2("final_score"), r2("count_score"), r2("time_score"), F.round("effective_news_count", 4).desc(), F.col("news_count").desc(), F.col("sector")]
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*(apart or [])).orderBy(*keys)))
    return out.where(F.col("rank") <= limit) if limit else out


def investment_preference(news: DataFrame, asof: Column | int, limit: int | None = None) -> DataFrame:
    return ranked(preference_scores(aged_news(news, asof), ["sector"]), "preference", limit=limit)


def market_heat(news: DataFrame, asof: Column | int, limit: int | None = None) -> DataFrame:
    return ranked(heat_scores(aged_news(news, asof), ["sector"]), "heat", limit=limit)


def ranking_days(news: DataFrame, first_day: str, last_day: str, kind: str = "preference") -> DataFrame:
    """biz_date and that day's ranking as of its midnight UTC. Every news row is copied to the days whose window holds it."""
    ts = F.col("publish_ts")
    lead = F.greatest(F.to_date(F.timestamp_seconds(ts)), F.to_date(F.lit(first_day)))
    days = F.sequence(lead, F.least(F.to_date(F.timestamp_seconds(ts + WINDOW_S)) + F.lit(1), F.to_date(F.lit(last_day))))
    spread = news.where(lead <= F.to_date(F.lit(last_day))).withColumn("biz_date", F.explode(days))
    aged = aged_news(spread, F.unix_seconds(F.col("biz_date").cast("timestamp")))
    scores = preference_scores(aged, ["biz_date", "sector"]) if kind == "preference" else heat_scores(aged, ["biz_date", "sector"])
    return ranked(scores, kind, ["biz_date"])


def ranking_asof(days: DataFrame, biz_date: str) -> DataFrame:
    """The ranking of biz_date, else of the last day before it; dates are compared as dates."""
    best = days.where(F.col("biz_date") <= F.to_date(F.lit(biz_date))).agg(F.max("biz_date").alias("best"))
    return days.join(F.broadcast(best), F.col("biz_date") == F.col("best")).drop("best")


def ranking_history(days: DataFrame, biz_date: str, topn: int = 5, history_days: int = 7) -> DataFrame:
    """The score series, over the last history_days rankings, of the topn sectors of the ranking at biz_date."""
    top = ranking_asof(days, biz_date).where(F.col("rank") <= topn).select("sector", F.col("rank").alias("top_rank"))
    place = F.dense_rank().over(Window.orderBy(F.col("biz_date").desc()))
    dates = days.where(F.col("biz_date") <= F.to_date(F.lit(biz_date))).select("biz_date").distinct().withColumn("back", place).where(F.col("back") <= history_days)
    return days.join(F.broadcast(dates), "biz_date").join(F.broadcast(top), "sector").select("sector", "top_rank", "biz_date", "rank", "final_score", "news_count")


def ranking_payload(ranking: DataFrame, limit: int = 12) -> DataFrame:
    """sector, rank, final_score to two digits and news_count, by rank, then score, then name."""
    slim = ranking.select(clean(F.col("sector")).alias("sector"), "rank", F.round("final_score", 2).alias("final_score"), F.greatest(F.col("news_count"), F.lit(0)).alias("news_count"))
    return slim.where("sector <> ''").orderBy("rank", F.col("final_score").desc(), "sector").limit(limit)
