"""Landed payloads, panels, search and landing functions on hand-made rows with their edges."""

import datetime

from pyspark.sql import functions as F

from tickerloom.functions import landing as L
from tickerloom.functions import newstext as X
from tickerloom.functions import payloads as Y
from tickerloom.operators import panels as N
from tickerloom.operators import search, sectors

NOW = 1_700_000_000


def test_news_items_of_every_shape(spark):
    item = '{"id": 7, "title": "", "content": "【 T 】 body ", "ctime": 1700000000, "subjects": [{"subject_name": " a "}, {"subject_name": "a"}, {}, {"subject_name": ""}]}'
    bare = '{"event_id": "", "id": "", "content": "no title", "time": "1700000000123"}'
    bodies = [f'{{"data": {{"roll_data": [{item}]}}}}', f'{{"data": {{"data": [{item}, {bare}]}}}}', f'{{"data": {{"list": []}}}}', f'{{"data": [{item}]}}', '{"data": {"list": [{"content": "x", "ctime": "soon"}]}}', "broken", None, "{}"]
    rows = Y.news_items(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(r.event_id, r.title, r.content, r.subjects, r.publish_time) for r in rows if r.event_id == "7"] == [("7", "T", "body", ["a"], "06:13:20")] * 3
    other = [r for r in rows if r.event_id != "7"]
    assert len(other) == 1 and other[0].publish_ts == 1700000000 and len(other[0].event_id) == 32 and other[0].subjects == []


def test_flashes_between_times_and_words(spark):
    page = "快讯\n09:30\nA股\n重要\n# t1 \nc1\n09:31\n09:32\nt2\n09:33\nt3\nc3\n09:33\nt3\nc3\n10:00:01\nonly a title"
    found = {(r.clock, r.title, r.content) for r in Y.flash_items(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "09:30")], "page_id int, text string")).collect()}
    assert found == {("09:30", "t1", "c1"), ("09:33", "t3", "c3")}


def test_sections_keep_lines_in_order(spark):
    text = "head 1\r\n\r\n x【公司公告】y\nc 1\n c 2 \n【券商观点】\n【公司公告】\nc 3"
    found = {(r.doc_id, r.section): r.body for r in Y.sections(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id int, text string")).collect()}
    assert found == {(1, "head"): "head 1", (1, "company_announcements"): "c 1\nc 2\nc 3", (2, "head"): "plain"}


def test_feed_stories(spark):
    cases = [("【标题】正文", "", "标题", "正文"), ("标题一二 金十数据4月5日讯，正文 - 金十数据", "短", "标题一二", "正文"), ("正文 - 金十数据 2026-04-05 周日 21:20:30 标题 正文", "短摘要", "短摘要", "正文"), ("", "摘要 分享", "", "摘要 分享"), (None, None, "", ""), ("【金十数据】正文", "", "", "正文")]
    rows = spark.createDataFrame(cases, "content string, summary string, title string, want string")
    got = rows.select("title", "want", Y.feed_title(F.col("summary"), F.col("content")).alias("t"), Y.feed_content(F.col("content"), F.col("summary")).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [(r.title, r.want) for r in got]


def test_vendor_rows(spark):
    fields = {f: "1.5" for f in Y.QUOTE_FIELDS} | {"f2": "0", "f9": "--", "f10": "x", "f21": "30"}
    rows = spark.createDataFrame([{"f12": "000001", "f14": "n", **fields}, {"f12": "000002", "f14": "m", **fields, "f2": "2"}, {"f12": "", "f14": "m", **fields}, {"f12": "3", "f14": None, **fields}])
    found = {r.symbol: r for r in Y.quote_rows(rows).collect()}
    assert set(found) == {"000001", "000002"} and found["000001"].float_shares is None and found["000002"].float_shares == 15.0
    assert found["000001"].pe_ratio is None and found["000001"].volume_ratio is None and found["000001"].open_price == 1.5
    history = spark.createDataFrame([("s", "n", ["2024-01-02,1,2,3,0.5,9,7,6,5,4,3", "bad", "2024-01-03,1,-,3,0.5,9,7,6,5,4,3,extra", "2024-01-04,1,NaN,3,0.5,9,7,6,5,4,3"])], "symbol string, name string, lines array<string>")
    bars = Y.history_rows(history).orderBy("trade_date").collect()
    assert [(r.close_price, r.prev_close_price) for r in bars] == [(2.0, None), (None, 2.0), (None, None)]


def test_sector_links(spark):
    html = '<a href="/x">x</a><a class=a href=\'http://q/thshy/detail/code/881121/\'> 半导体 </a><a href="/thshy/detail/code/881105"><i>煤炭</i></a><a href="/thshy/detail/code/881105/">煤炭</a><a href="/thshy/detail/code/881106/"></a>'
    found = [tuple(r) for r in Y.sector_links(spark.createDataFrame([(html,), (None,)], "html string")).collect()]
    assert found == [("煤炭", "881105"), ("半导体", "881121")]
    named = Y.with_sector_codes(spark.createDataFrame([("煤炭",), ("银行",), (None,)], "sector string"), spark.createDataFrame(found, "sector_name string, sector_code string"))
    assert {tuple(r) for r in named.collect()} == {("煤炭", "881105"), ("银行", None), (None, None)}


def test_main_lines_and_reasons(spark):
    text = "开头\n第一主线：半导体 \n说明\n理由： r1\n\n more\n 第2主线: 煤炭\n理由：\nr2\n理由：r3\n第三主线：银行"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "无")], "k int, analysis_text string")
    found = {(r.k, r.rank): (r.sector_name, r.reason) for r in N.mainline_reasons(docs, "k").collect()}
    assert found == {(1, 1): ("半导体", "r1\nmore"), (1, 2): ("煤炭", "r2\nr3"), (1, 3): ("银行", "")}
    names = {r.k: (r.n, r.d) for r in docs.select("k", N.mainlines(F.col("analysis_text")).alias("n"), N.digest_lines(F.col("analysis_text")).alias("d")).collect()}
    assert names[1][0] == ["半导体", "银行"] and names[1][1].startswith("**第一主线：半导体**\n\n> 理由： r1") and names[2][1] == N.NO_ANALYSIS and names[3][1] == "无"
    five = "\n".join(f"第{o}主线：{s}" for o, s in zip("一二三四五", ("半导体", "白酒", "银行", "证券", "中药"), strict=True))
    checked = spark.createDataFrame([(five,), (five.replace("中药", "别的"),), (five + "\n第五主线：银行",), (None,)], "t string")
    assert [r[0] for r in checked.select(N.mainlines_valid(F.col("t"))).collect()] == [True, False, False, False]


def test_panel_times_and_rows(spark):
    texts = {"2024-03-01T01:30:00Z": "2024-03-01 09:30:00", "2024-03-01T01:30:00+08:00": "2024-03-01 01:30:00", "2024-03-01 01:30:00": "2024-03-01 01:30:00", "later": "later", " ": None}
    rows = spark.createDataFrame(list(texts.items()), "t string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", N.local_time_text(F.col("t"))).collect())


def test_documents_by_day_with_fallbacks(spark):
    d = lambda n: datetime.date(2024, 1, n)
    docs = spark.createDataFrame([(d(1), d(2), 1), (d(1), d(2), 2), (d(3), None, 1)], "analysis_date date, trade_date date, updated_at int")
    days = spark.createDataFrame([(d(1),), (d(2),), (d(3),), (d(9),)], "day date")
    found = {r.day: (r.analysis_date, r.updated_at) for r in N.docs_for(docs, days).collect()}
    assert found == {d(1): (d(1), 2), d(2): (d(1), 2), d(3): (d(3), 1), d(9): (d(3), 1)}
    assert {r.day: r.analysis_date for r in N.docs_for(docs.limit(0), days).collect()} == {d(1): None, d(2): None, d(3): None, d(9): None}


def test_landing_functions(spark):
    lines = spark.createDataFrame([("a   b\n\na b\nwindow.location.href = 1\nc",), (None,)], "t string").select(L.unique_lines(F.col("t"))).collect()
    assert [r[0] for r in lines] == [["a b", "c"], []]
    codes = spark.createDataFrame([("代码600519涨 600519 000001x 000002",), (None,)], "t string").select(L.codes_in_text(F.col("t"))).collect()
    assert codes[0][0] == ["600519", "000002"] and codes[1][0] == []  # a code beside letters of any script is none
    batch = spark.createDataFrame([("a", 1, "x", 0), ("a", 5, "y", 1), ("b", 9, "", 2), ("c", None, "z", 3), ("d", 7, "w", 4)], "event_id string, publish_ts bigint, content string, met int")
    assert [(r.event_id, r.publish_ts) for r in L.batch_clean(batch, "met").collect()] == [("d", 7), ("a", 1)]
    assert [r.event_id for r in L.batch_clean(batch, "met", 1).collect()] == ["d"]


def test_search_bounds_of_a_local_day(spark):
    start = int(datetime.datetime(2024, 1, 28, 16, tzinfo=datetime.UTC).timestamp())
    rows = spark.createDataFrame([("a", start - 1, "x"), ("b", start, "K (x"), ("c", start + 86399, "k"), ("d", start + 86400, "k")], "event_id string, publish_ts bigint, title string").withColumns({"content": F.lit(None).cast("string"), "source": F.lit("cls"), "score": F.lit(1), "sectors": F.array(F.lit("s"))})
    assert {r.event_id for r in search.filtered(rows, trade_date="2024-01-29").collect()} == {"b", "c"}
    assert {r.event_id for r in search.filtered(rows, keyword="K", sector="s", min_score=1, source="cls").collect()} == {"b", "c", "d"}
    assert [r.event_id for r in search.page(rows, -5, 0).collect()] == ["d"]


def test_heat_formula_and_rank_ties(spark):
    rows = spark.createDataFrame([("1", NOW, ["b"], 0), ("2", NOW, ["a"], 0), ("3", NOW - 20 * 3600, ["c "], None)], "event_id string, publish_ts bigint, sectors array<string>, score int")
    found = sectors.market_heat(rows, NOW).orderBy("rank").collect()
    assert [r.sector for r in found] == ["a", "b", "c"] and found[2].recent_count == 0
    import math

    e = math.exp(-math.log(2) * 2 / 18)
    assert abs(found[2].final_score - (0.75 * 100 * math.tanh(e / 6) + 25 * e)) < 1e-9


def test_scorer_answers_of_every_type(spark):
    cases = [('{"score": true}', 0), ('{"score": 2.5}', 2), ('{"score": 3.5}', 4), ('{"score": "up -12%"}', -12), ('{"score": null}', 0), ('{"score": 1e3}', 100), ("```json\n{\"score\": 5}\n```", 5)]
    rows = spark.createDataFrame(cases, "t string, want int")
    got = rows.select("want", X.analysis_payload(F.col("t"), F.lit(""), F.array().cast("array<string>")).alias("p")).collect()
    assert [r.p.score for r in got] == [r.want for r in got] and all(r.p.reason == X.NO_REASON and r.p.companies is None and r.p.sectors is None for r in got)
    assert spark.createDataFrame([("none",), (None,)], "t string").select(X.analysis_payload(F.col("t"), F.lit(""), F.array().cast("array<string>")).alias("p")).where("p IS NOT NULL").count() == 0


def test_texts_are_read_once(spark):
    names = F.col("names")
    assert str(X.analysis_payload(F.col("told"), F.col("content"), names)).count("parse_json") == 1
    assert str(X.norm_sector_list(names, F.col("content"), names)).count("冻猪肉") == 1


def test_lists_of_names_end_with_the_first_that_says_something(spark):
    cases = [(["某芯片、公司", " 白\\酒", "不明", "半导体", "ETF-铜", "保险"], ["银行"], "游戏", ["半导体", "白酒", "工业金属"]), (["不明", None], [" 银 行", "E-x"], "游戏", ["银行"]), ([], None, "票房和游戏", ["影视院线", "游戏"]), (None, [""], None, None)]
    rows = spark.createDataFrame(cases, "a array<string>, b array<string>, c string, want array<string>")
    assert all(r.got == r.want for r in rows.withColumn("got", X.norm_sector_list(F.col("a"), F.col("c"), F.col("b"))).collect())


def test_lines_and_bodies_are_not_read_again_to_filter_them(spark):
    pages = spark.createDataFrame([(1, "10:00\n 重要\n##  t  x \n c　 d\n\n12:00:01\n13:00\ne")], "page_id int, text string")
    plan = Y.flash_items(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_replace" in x]
    assert [tuple(r) for r in Y.flash_items(pages).collect()] == [(1, "10:00", "t x", "c d", 0)]
    bodies = spark.createDataFrame([('{"data": {"list": [{"id": "1", "ctime": "9", "content": "x"}, null]}}',), ('{"data": []}',), (None,)], "body string")
    plan = Y.news_items(bodies)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "from_json" in x]
    assert [(r.event_id, r.publish_ts) for r in Y.news_items(bodies).collect()] == [("1", 9)]
