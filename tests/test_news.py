"""News operators on small hand-made rows, held against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import newstext as X
from tickerloom.operators import bars, sectors, story_dedup
from tickerloom.operators.components import components
from tickerloom.operators.store import upsert, upsert_daily, upsert_news
from tickerloom.streaming import ingest
from tickerloom.streaming.repair import guarded

NOW = 1_700_000_000


def news(spark, rows):
    return spark.createDataFrame([{"event_id": str(i), "source": "cls", "title": None, "content": None, "subjects": None, "score": 0, "companies": None, "sectors": None, "publish_ts": NOW, **r} for i, r in enumerate(rows)], ingest.NEWS_SCHEMA)


def test_summary_counts_untrimmed_names_apart(spark):
    rows = news(spark, [{"sectors": ["A", "A "], "score": 5}, {"sectors": [], "score": 9}, {"sectors": ["B"], "publish_ts": NOW - 72 * 3600, "score": None}, {"sectors": ["B"], "publish_ts": NOW - 72 * 3600 - 1}])
    got = {r.sector: (r.news_count, r.score_sum) for r in sectors.sector_summary(rows, NOW).collect()}
    assert got == {"A": (2, 10), "B": (1, 0)}


def test_preference_formula(spark):
    data = [(80, 0), (-50, 20 * 3600), (150, 60 * 3600), (0, 3600)]
    rows = news(spark, [{"sectors": ["A", "A "], "score": s, "publish_ts": NOW - age} for s, age in data])
    got = sectors.investment_preference(rows, NOW).first()
    e = effects = p = n = up = down = 0.0
    for score, age_s in data:
        score, age = max(-100, min(100, score)), age_s / 3600
        s = abs(score) / 100
        strength = math.copysign(100 * s ** (2.6 - 1.6 * s), score) if score else 0.0
        decay = 1.0 if age <= 18 else math.exp(-math.log(2) * (age - 18) / (18 + 18 * s**1.5))
        e, effects = e + decay, effects + strength * decay
        p, n = p + decay * (score >= 20), n + decay * (score <= -20)
        up, down = max(up, abs(strength) / 100 * decay if score > 0 else 0), max(down, abs(strength) / 100 * decay if score < 0 else 0)
    event, count, time = 100 * math.tanh(effects / math.sqrt(max(e, 1)) / 60), 100 * math.tanh((math.log(1 + p) - math.log(1 + n)) / 1.6), 100 * (up - down)
    assert got.news_count == 4 and abs(got.final_score - (0.75 * event + 0.08 * count + 0.17 * time)) < 1e-9


def test_sector_names(spark):
    names = [" 半导体　", "某芯片公司", "小金属-", "光伏、设备", "xyz", None, "银 行"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = {r.i: r.s for r in rows.select("i", X.norm_sector(F.col("name")).alias("s")).collect()}
    assert got == {0: "半导体", 1: "半导体", 2: "小金属", 3: "光伏设备", 4: None, 5: None, 6: "银行"}


def test_score_postprocess(spark):
    rows = spark.createDataFrame([(0, ["银行"], "公司签约"), (0, ["银行"], "公司处罚 3 人"), (0, [], "签约"), (250, ["银行"], ""), (None, ["银行"], None)], "s int, sectors array<string>, text string")
    got = [r[0] for r in rows.select(X.score_postprocess(F.col("s"), F.col("sectors"), F.col("text"))).collect()]
    assert got == [15, -35, 0, 100, 0]


def test_scores_read_the_given_columns_in_a_select_that_names_others_so_before(spark):
    """The aliases of a select that stand before an expression are not what its columns mean."""
    cases = [(28, ["银行"], "公司签约 3 家"), (-50, ["银行"], "公司处罚 3 人"), (0, ["银行"], "公司签约"), (0, [], "签约"), (60, None, "收储")]
    rows = spark.createDataFrame(cases, "score int, sectors array<string>, said string")
    others = F.lit(0).alias("score"), F.array(F.lit("x")).alias("sectors"), F.lit("公司处罚").alias("said")
    score, sectors, said = F.col("score"), F.col("sectors"), F.col("said")
    asked = X.score_postprocess(score, sectors, said).alias("told"), X.needs_repair(said, F.array(F.lit("银行")), sectors, score).alias("repair")
    got = [(r.told, r.repair) for r in rows.select(*others, *asked).collect()]
    assert got == [(28, True), (-50, False), (15, True), (0, True), (60, True)]


def test_strip_title(spark):
    cases = [("【标题一二三】正文内容", "标题一二三", "正文内容"), ("标题：正文", "标题", "正文"), ("标题", "标题", "标题"), ("其他", "标题", "其他"), (None, "标题", "")]
    rows = spark.createDataFrame(cases, "content string, title string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", X.strip_title(F.col("content"), F.col("title"))).collect())


def test_greedy_pass_against_loop_over_everything(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [f"story number {rng.randrange(25)} tells"] if rng.random() < 0.9 else ["x"]
        rows.append({"event_id": f"{i:03d}", "publish_ts": NOW + rng.randrange(40), "source": rng.choice(["cls", "jin10", "10jqka"]), "title": rng.choice([None, f"headline {rng.randrange(12)}"]), "content": words[0], "subjects": ["s"] * rng.randrange(3)})
    table = news(spark, rows)
    keyed = {r.event_id: set(r["keys"]) for r in story_dedup.with_keys(table).collect()}
    order = sorted(rows, key=lambda r: (r["publish_ts"], story_dedup.SOURCE_ORDER.index(r["source"]), r["event_id"]))
    rank = lambda r: (len(r["content"]), len(r["subjects"]), bool(r["title"]), r["source"] == "cls", r["publish_ts"])
    clusters, alone = [], []
    for r in order:
        keys = keyed[r["event_id"]]
        if not keys:
            alone.append(r["event_id"])
            continue
        home = next((c for c in clusters if c[0] & keys), None)
        if home is None:
            clusters.append([set(keys), r])
        else:
            home[0] |= keys
            if rank(r) > rank(home[1]):
                home[1] = r
    want = sorted([*alone, *(c[1]["event_id"] for c in clusters)])
    assert sorted(r.event_id for r in story_dedup.greedy(table).select("event_id").collect()) == want


def _greedy_loop(keyed):
    """event_ids kept of (event_id, keys, rank) in order of arrival."""
    clusters = []
    for event_id, keys, rank in keyed:
        home = next((c for c in clusters if c[0] & keys), None)
        if home is None:
            clusters.append([set(keys), rank, event_id])
            continue
        home[0] |= keys
        if rank > home[1]:
            home[1:] = rank, event_id
    return sorted(c[2] for c in clusters)


def test_greedy_hot_key_is_never_whole_in_one_task(spark, monkeypatch):
    """A key of most rows spans many chunks; what earlier chunks end with is carried over, and no pandas task takes a group."""
    monkeypatch.setattr(story_dedup, "CHUNK", 16)
    rng = random.Random(7)
    rows = [{"event_id": f"{i:04d}", "publish_ts": NOW + i, "title": rng.choice(["everyday headline"] * 3 + [f"headline {rng.randrange(30)}"]), "content": f"story number {rng.randrange(150)} tells" + "." * rng.randrange(4)} for i in range(500)]
    table = news(spark, rows)
    keys = {r.event_id: set(r["keys"]) for r in story_dedup.with_keys(table).collect()}
    want = _greedy_loop([(r["event_id"], keys[r["event_id"]], (len(r["content"]), r["publish_ts"])) for r in rows])
    kept = story_dedup.greedy(table)
    assert sorted(r.event_id for r in kept.select("event_id").collect()) == want
    _, edges = story_dedup._placed(table, story_dedup.scratch_table)
    assert edges.groupBy("key", "chunk").count().agg(F.max("count")).first()[0] <= 16
    assert edges.groupBy("key").count().agg(F.max("count")).first()[0] > 300
    assert not hasattr(story_dedup, "_greedy_pass")


def test_greedy_chain_in_order_of_arrival(spark):
    """Each story shares a key with the next; all reach the first one."""
    chain = spark.createDataFrame([(i, 0, k.to_bytes(8)) for i in range(300) for k in (i, i + 1)], "place bigint, chunk bigint, key binary")
    homes = {r.place: r.home for r in story_dedup.greedy_homes(chain).collect()}
    assert homes == dict.fromkeys(range(300), 0)


def test_components_of_a_long_shuffled_chain(spark):
    ids = [f"{i:04d}" for i in range(400)]
    random.Random(1).shuffle(ids)
    chain = spark.createDataFrame([(e, [f"key {i}", f"key {i + 1}"]) for i, e in enumerate(ids)] + [("apart", ["other"])], "event_id string, keys array<string>")
    got = {r.event_id: r.component for r in story_dedup.key_components(chain).collect()}
    assert got == dict.fromkeys(ids, "0000") | {"apart": "apart"}


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a int, b int")
    with pytest.raises(RuntimeError):
        components(chain, most_rounds=2)


def test_ema_and_merge(spark):
    closes = [1.0, 2.0, 4.0, 3.0]
    table = spark.createDataFrame([("s", f"2024-01-0{i + 1}", c, c, c, c) for i, c in enumerate(closes)], "symbol string, trade_date string, open double, high double, low double, close double")
    want = list(itertools.accumulate(closes, lambda acc, c: acc + 2 / 21 * (c - acc)))[-1]
    assert abs(bars.ema(table).first().ema - want) < 1e-12
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, created string")
    new = spark.createDataFrame([(2, None, "z"), (3, "d", "w")], "k int, v string, created string")
    assert {tuple(r) for r in upsert(old, new, ["k"], keep=("created",)).collect()} == {(1, "a", "x"), (2, None, "y"), (3, "d", "w")}


def test_stream_drops_late_rows_per_source(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "check"))
    text = "a long enough story about thing number "
    news(spark, [{"event_id": "a", "publish_ts": NOW, "content": text + "one"}, {"event_id": "b", "publish_ts": NOW, "source": "jin10", "content": text + "one"}]).coalesce(1).write.parquet(source)
    ingest.start(spark, source, store, checkpoint).awaitTermination(120)
    news(spark, [{"event_id": "c", "publish_ts": NOW - 1, "content": text + "two"}, {"event_id": "d", "publish_ts": NOW, "content": text + "three"}, {"event_id": "a", "publish_ts": NOW, "content": text + "four"}]).coalesce(1).write.mode("append").parquet(source)
    ingest.start(spark, source, store, checkpoint, views=True).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(f"{store}/rows").collect()) == ["a", "d"]
    assert spark.read.parquet(f"{store}/views/batch=1").count() == 0  # no sectors in these rows


def test_stream_state_names_live_batches_only(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "check"))
    for k in range(4):
        rows = [{"event_id": f"{k}", "publish_ts": NOW + k * 40 * 86400, "sectors": ["银行"], "score": 50, "content": f"a long enough story about thing number {k}"}]
        news(spark, rows).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark, source, store, checkpoint, views=True).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(f"{store}/rows").collect()) == ["0", "1", "2", "3"]
    assert [r.batch for r in spark.read.schema(ingest.STATE_SCHEMA).parquet(f"{store}/state/batch=3").collect()] == [3]
    views = {r.view: r for r in spark.read.parquet(f"{store}/views/batch=3").collect()}
    assert {v: (r.sector, r.news_count) for v, r in views.items()} == {v: ("银行", 1) for v in ("summary", "preference", "heat")}


def test_failed_scores_are_neutral(spark):
    def scorer(batches):
        for rows in batches:
            if rows["content"].str.contains("bad").any():
                raise ValueError("no answer")
            yield rows.assign(score=77)

    rows = news(spark, [{"content": "good one", "score": 5}, {"content": "bad one", "score": 5}, {"content": " ", "score": 5, "sectors": ["银行"]}, {"content": None, "score": 5}]).coalesce(1)
    got = {r.event_id: r.score for r in rows.mapInPandas(guarded(scorer), ingest.NEWS_SCHEMA).collect()}
    assert got == {"0": 77, "1": 0, "2": 0, "3": 0}


def test_merges_keep_what_they_must(spark):
    old = spark.createDataFrame([("2024-01-01", 1, "first")], "biz_date string, n int, created_at string")
    new = spark.createDataFrame([("2024-01-01", 2, "second"), ("2024-01-02", 3, "second")], "biz_date string, n int, created_at string")
    assert {tuple(r) for r in upsert_daily(old, new, text_key=True).collect()} == {("2024-01-01", 2, "first"), ("2024-01-02", 3, "second")}
    for blank in (" ", None):
        with pytest.raises(Exception, match="must not be blank"):
            upsert_daily(old, spark.createDataFrame([(blank, 2, "x")], "biz_date string, n int, created_at string"), text_key=True).collect()
    rows = news(spark, [{"event_id": "a", "score": 1}, {"event_id": "a", "score": 2, "publish_ts": NOW + 1}])
    assert [(r.event_id, r.score) for r in upsert_news(news(spark, []), rows).collect()] == [("a", 2)]
    assert [(r.event_id, r.score) for r in upsert_news(rows.where("score = 2"), rows.where("score = 1")).collect()] == [("a", 1)]


def test_dedup_text_restated(spark):
    cases = {" 财联社4月5日电，A b。 ": "ab", "[金十数据]：Story - 金十数据  ": "story", "财联社讯 x": "财联社讯x".replace("财联社", ""), "a　b\u00a0(同花顺)": "ab", "no feed – here": "nofeed–here", None: ""}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", X.dedup_text(F.col("t"))).collect())


def test_keys_are_not_worked_out_again_to_filter_them(spark):
    rows = news(spark, [{"title": "headline of a story", "content": "headline of a story and what it tells"}, {"content": "x"}])
    texts = [plan._jdf.queryExecution().optimizedPlan().toString() for plan in (story_dedup.key_rows(rows), story_dedup.shared_key_pairs(rows))]
    assert all("Filter" not in text[text.index("Project") :] for text in texts)
    assert sorted(r.key for r in story_dedup.key_rows(rows).collect()) == ["content::andwhatittells", "content::headlineofastoryandwhatittells", "title::headlineofastory"]


def test_a_pair_of_keys_is_one_link_however_many_rows_name_it(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(story_dedup, "components", lambda links, **more: seen.append(links.count()) or components(links, **more))
    rows = news(spark, [{"title": "headline one" if i % 2 else "headline two", "content": f"a story that {i % 3} tells"} for i in range(60)])
    got = story_dedup.transitive(rows).select("event_id", "component").collect()
    # Two titles and three contents: six pairs, no link per row; all content is equally long, so the first row stays.
    assert seen[0] <= 6 and [tuple(r) for r in got] == [("0", "0")]


def test_transitive_keeps_ties_in_order_and_rows_without_time_last(spark):
    same = {"title": "headline one", "content": "a story that one tells"}
    rows = news(spark, [{**same, "source": "jin10", "publish_ts": None}, {**same, "source": "jin10"}, {**same, "source": "10jqka"}, {"content": "short"}])
    got = sorted((r.event_id, r.component) for r in story_dedup.transitive(rows).collect())
    # Equal preferences and times: jin10 comes before 10jqka; the row without a time is preferred to none.
    assert got == [("1", "0"), ("3", "3")]


def test_rounds_of_the_greedy_pass_take_only_rows_that_change_a_key(spark, monkeypatch):
    seen, step = [], story_dedup._next_homes
    monkeypatch.setattr(story_dedup, "_next_homes", lambda edges, homes: seen.append(edges.select("place").distinct().count()) or step(edges, homes))
    # Key 0 is in every row, key 1 in rows 0 and 150; the others have one key.
    rows = [(i, i // 16, bytes([0])) for i in range(300)] + [(0, 0, bytes([1])), (150, 9, bytes([1]))]
    homes = {r.place: r.home for r in story_dedup.greedy_homes(spark.createDataFrame(rows, "place bigint, chunk bigint, key binary")).collect()}
    assert homes == dict.fromkeys(range(300), 0) and max(seen) == 2
