"""Hourly views from panes against recomputation at every hour, over gaps, stretches, window ends and batches of a stream."""

import random

from pyspark.sql import functions as F

from tickerloom.functions.newstext import SECTORS
from tickerloom.operators import panes as P
from tickerloom.operators import sectors as S
from tickerloom.streaming import ingest

HOUR = 3600
#: A stretch ends within the hours that are looked at.
BASE = 700 * P.STRETCH_H - 90


def news(spark, rows):
    full = [(f"{i:05d}", ts, "cls", "", "", [], score, [], sectors) for i, (ts, score, sectors) in enumerate(rows)]
    return spark.createDataFrame(full, ingest.NEWS_SCHEMA)


def edge_rows():
    rng = random.Random(2)
    at = lambda h, s=0: (BASE + h) * HOUR + s
    rows = [(at(0), 50, ["A"]), (at(0, 1), -30, ["A", " A", "A "]), (at(72), 100, ["A"]), (at(18), 0, ["B"]), (at(18, 1), None, ["B", "B"]), (at(20, 3599), 20, []), (at(21), -20, None), (at(22), 7, [" ", ""])]
    rows += [(at(rng.randrange(-75, 200), rng.choice([0, 0, 1, 1800, 3599])), rng.randint(-140, 140), rng.sample(["A", "B", "C", "D　"], rng.randint(1, 3))) for _ in range(250)]
    rows += [(at(420), 90, ["E"]), (None, 5, ["A"])]
    return rows


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9 * max(1, abs(a)))


def same(mine, plain, columns):
    a, b = ({(r["sector"]): r for r in x} for x in (mine, plain))
    assert set(a) == set(b)
    for k in a:
        assert all(close(a[k][c], b[k][c]) for c in columns), (a[k], b[k])


def test_every_hour_equals_the_recomputation(spark):
    rows = news(spark, edge_rows()).cache()
    hours = [BASE + h for h in (0, 18, 19, 72, 73, 90, 163, 492)]
    parts = P.merged_panes(*[P.panes(rows.where(F.col("event_id").cast("int") % 3 == i)) for i in range(3)])
    of = P.states(parts, BASE, BASE + 500).cache()
    got = {name: f(of).collect() for name, f in (("p", P.hourly_preference), ("h", P.hourly_heat), ("s", P.hourly_summary))}
    for hour in hours:
        at = {k: [r for r in v if r["hour"] == hour] for k, v in got.items()}
        same(at["p"], S.investment_preference(rows, hour * HOUR).collect(), ["news_count", "positive_count", "negative_count", "neutral_count", "latest_ts", "top_positive", "top_negative", "event_score", "count_score", "time_score", "final_score"])
        same(at["h"], S.market_heat(rows, hour * HOUR).collect(), ["news_count", "effective_news_count", "recent_count", "latest_ts", "count_score", "time_score", "final_score"])
        same(at["s"], S.sector_summary(rows, hour * HOUR).collect(), ["news_count", "score_sum"])
    assert not [r for r in got["p"] if BASE + 372 <= r["hour"] < BASE + 420 and r["sector"] == "A"]


def test_no_news_no_views(spark):
    assert P.hourly_views(P.panes(news(spark, [])), BASE, BASE + 5).collect() == []


def test_rows_are_read_once(spark):
    """Panes hold a row per sector, score and hour however many news there are, and only they reach the hours."""
    rows = news(spark, [((BASE + i % 3) * HOUR + 1 + i % 3000, 50, ["A"]) for i in range(3000)])
    parts = P.panes(rows)
    assert parts.where("score IS NOT NULL").count() == 3 and parts.agg(F.sum("n")).first()[0] == 6000


def test_stream_moves_views_forward(spark, tmp_path):
    """A stream's hourly views equal those of all its rows at once, over a gap, a late row and a batch of nothing new."""
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "check"))
    at = lambda h, s=0: (BASE + h) * HOUR + s
    batches = [
        [("a", at(0, 5), "cls", 40), ("b", at(2), "jin10", -60), ("c", at(3, 10), "cls", 80)],
        [("d", at(2, 30), "jin10", 30), ("e", at(30, 1), "cls", -90)],
        [("e", at(30, 1), "cls", -90)],
        [("f", at(110), "cls", 70), ("g", at(29), "jin10", 25)],
    ]
    for rows in batches:
        full = [(i, ts, src, "", f"story {i} of its own", [], score, [], [SECTORS[0]]) for i, ts, src, score in rows]
        spark.createDataFrame(full, ingest.NEWS_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark, source, store, checkpoint, hours=True).awaitTermination(120)
    stored = spark.read.schema(ingest.NEWS_SCHEMA + ", batch int").parquet(f"{store}/rows")
    assert stored.count() == 7
    got = {(r.hour, r.view, r.sector, r["rank"], r.news_count, r.score) for r in ingest.hourly(spark, store).select("hour", "view", "sector", "rank", "news_count", "score").collect()}
    want = {tuple(r) for r in P.hourly_views(P.panes(stored), BASE + 1, BASE + 110).collect()}
    assert got == want and len({h for h, *_ in got}) == 103
