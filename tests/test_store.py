"""Stored versions: what a merge rewrites, what readers see, crashes, conflicts and replays; rejected rows."""

import pytest
from pyspark.sql import functions as F

from tickerloom.operators.rejects import answer_rules, bar_rules, routed, symbol_rules
from tickerloom.operators.store import BARS_TABLE, NEWS_TABLE, merge_bars
from tickerloom.plans import store_queries
from tickerloom.sources.versioned import VersionConflict, VersionedTable

SCHEMA = "trade_date date, symbol string, close double, id string, created_at string"


def bars(spark, rows):
    return spark.createDataFrame([(d, s, c, f"{d}{s}{c}", w) for d, s, c, w in rows], "d string, symbol string, close double, id string, created_at string").select(F.to_date("d").alias("trade_date"), "symbol", "close", "id", "created_at")


def files(table, version=None):
    return {r[0] for r in table.read(version).select("_metadata.file_path").distinct().collect()}


def seen(table, **how):
    return {(str(r.trade_date), r.symbol, r.close, r.created_at) for r in table.read(**how).collect()}


@pytest.fixture
def stored(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/bars", **BARS_TABLE)
    table.merge(bars(spark, [("2024-01-01", "a", 1.0, "x"), ("2024-01-01", "b", 2.0, "x"), ("2024-01-02", "a", 3.0, "x"), (None, "n", 9.0, "x")]))
    return table


def test_a_merge_rewrites_only_what_it_touches(spark, stored):
    before = files(stored)
    assert stored.merge(bars(spark, [("2024-01-02", "a", 4.0, "y"), ("2024-01-03", "c", 5.0, "y")])) == 1
    untouched = {f for f in before if "2024-01-02" not in f}
    assert untouched < before and untouched <= files(stored) and files(stored) & before == untouched
    assert seen(stored) == {("2024-01-01", "a", 1.0, "x"), ("2024-01-01", "b", 2.0, "x"), ("2024-01-02", "a", 4.0, "x"), ("2024-01-03", "c", 5.0, "y"), ("None", "n", 9.0, "x")}
    assert {r.id for r in stored.read(parts=["2024-01-02"]).collect()} == {"2024-01-02a3.0"}
    assert [tuple(r) for r in stored.history().orderBy("version").collect()] == [(0, 3, 4, 3), (1, 4, 5, 2)]
    assert stored.has_parts(["2024-01-03", "2024-01-04"]) == {"2024-01-03": True, "2024-01-04": False}


def test_readers_keep_their_version(spark, stored):
    open_ = stored.read()
    stored.merge(bars(spark, [("2024-01-01", "a", 7.0, "y")]))
    assert {r.close for r in open_.collect()} == {1.0, 2.0, 3.0, 9.0} == {c for _, _, c, _ in seen(stored, version=0)}
    assert {c for _, _, c, _ in seen(stored)} == {7.0, 2.0, 3.0, 9.0}
    with pytest.raises(ValueError, match="no version 5"):
        stored.read(version=5)


def test_a_crash_before_the_rename_leaves_the_old_version(spark, stored, monkeypatch):
    old = seen(stored)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(stored, "_rename", crash)
    with pytest.raises(OSError, match="lost"):
        stored.merge(bars(spark, [("2024-01-01", "a", 7.0, "y"), ("2024-02-01", "z", 7.0, "y")]))
    assert stored.versions() == [0] and seen(stored) == old
    monkeypatch.undo()
    assert stored.merge(bars(spark, [("2024-02-01", "z", 7.0, "y")])) == 1
    assert seen(stored) == old | {("2024-02-01", "z", 7.0, "y")}
    assert len(stored.vacuum(keep=1)) == 1 and seen(stored) == old | {("2024-02-01", "z", 7.0, "y")}


def test_a_merge_that_loses_the_race_is_done_again(spark, stored, monkeypatch):
    commit, raced = stored._commit, []

    def late(manifest):
        if not raced:
            raced.append(manifest.version)
            VersionedTable(spark, stored.path, **BARS_TABLE).merge(bars(spark, [("2024-01-01", "a", 50.0, "other"), ("2024-03-01", "q", 6.0, "other")]))
        commit(manifest)

    monkeypatch.setattr(stored, "_commit", late)
    assert stored.merge(bars(spark, [("2024-01-01", "b", 60.0, "mine")])) == 2 and raced == [1]
    assert {(s, c) for _, s, c, _ in seen(stored)} == {("a", 50.0), ("b", 60.0), ("a", 3.0), ("q", 6.0), ("n", 9.0)}
    with pytest.raises(VersionConflict):
        commit(stored.manifest())


def test_batches_are_merged_once_and_rows_may_move(spark, tmp_path):
    news = lambda *rows: spark.createDataFrame(list(rows), "event_id string, publish_ts bigint, title string")
    table = VersionedTable(spark, f"file://{tmp_path}/news", **NEWS_TABLE)
    day = 86400
    assert table.merge(news(("a", 5 * day, "a"), ("b", 6 * day, "b"), ("n", None, "n")), batch=("s", 0)) == 0
    assert table.merge(news(("a", 9 * day, "moved"), ("a", 8 * day, "late")), by="publish_ts", batch=("s", 1)) == 1
    assert table.merge(news(("a", 1 * day, "replayed")), batch=("s", 1)) == 1
    assert table.merge(news(("c", 5 * day, "other stream")), batch=("t", 0)) == 2
    assert {tuple(r) for r in table.read().collect()} == {("a", 9 * day, "moved"), ("b", 6 * day, "b"), ("c", 5 * day, "other stream"), ("n", None, "n")}
    assert set(table.manifest().parts) == {"1970-01-06", "1970-01-07", "1970-01-10", "__none__"}


def test_empty_merges(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/bars", **BARS_TABLE)
    with pytest.raises(ValueError, match="no version yet"):
        table.read()
    assert table.merge(bars(spark, []).limit(0)) == 0 and table.read().collect() == []
    assert table.merge(bars(spark, [("2024-01-01", "a", 1.0, "x")])) == 1 and len(seen(table)) == 1


def test_rejected_bars_are_returned_with_reasons(spark, tmp_path):
    schema = "symbol string, trade_date date, open double, high double, low double, close double, created_at string, __x string"
    rows = [("a", "2024-01-01", 1.0, 2.0, 0.5, 1.5), ("b", "2024-01-01", 1.0, 0.5, 0.4, 1.5), ("c", "2024-01-01", 1.0, 2.0, 1.2, 1.5), ("d", "2024-01-01", None, 2.0, 0.5, 1.5), (" ", "2024-01-01", 1.0, 2.0, 0.5, 1.5), ("e", None, 1.0, 2.0, 0.5, 1.5), ("f", "2024-01-01", float("nan"), 2.0, 0.5, 1.5)]
    frame = spark.createDataFrame([(*r, "w", "x") for r in rows], schema.replace("date date", "date string")).withColumn("trade_date", F.to_date("trade_date"))
    table = VersionedTable(spark, f"file://{tmp_path}/bars", **BARS_TABLE)
    out = merge_bars(table, frame)
    assert [r.symbol for r in table.read().collect()] == ["a"]
    assert out.counts == {"no symbol or date": 2, "price missing": 2, "high below another price": 1, "low above another price": 1}
    found = {(r.reason, r.key): r.row for r in out.rejected.collect()}
    assert set(found) == {("no symbol or date", " /2024-01-01"), ("no symbol or date", "e"), ("price missing", "d/2024-01-01"), ("price missing", "f/2024-01-01"), ("high below another price", "b/2024-01-01"), ("low above another price", "c/2024-01-01")}
    assert '"open":null' in found["price missing", "d/2024-01-01"]


def test_symbols_and_answers_are_rejected_for_the_first_rule(spark):
    symbols = spark.createDataFrame([("600000",), ("700000",), ("12345",), (None,), ("６０００００",)], "symbol string")
    assert routed(symbols, "market_prefix", symbol_rules(), ["symbol"]).counts == {"not six digits": 3, "no market of this digit": 1}
    answers = spark.createDataFrame([('{"a": 1}',), ('x ```json\n{"a": 1}\n``` {',), ("none",), (None,), ('{"a": 1} end }',), ('{"a": 1}, {"b": 2}',), ("{'a': 1}",), ("{}",)], "answer string")
    out = routed(answers, "extract_json", answer_rules(), ["answer"])
    assert out.counts == {"no object": 2, "not JSON": 3} and out.passed.count() == 3


def test_symbols_of_high_part_keys_are_rejected_as_the_sql_says(spark, tmp_path):
    keys = [*range(1, 13), *range(99_995, 100_010), *range(699_995, 700_010), *range(1_000_000, 1_000_012)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.key: r.reason for r in routed(store_queries._symbols(spark, str(tmp_path)), "market_prefix", symbol_rules(), ["p_partkey"]).rejected.collect()}

    def want(k):
        if k % 6 == 2 or (k % 6 == 0 and len(str(k)) != 6):
            return "not six digits"
        return "no market of this digit" if k % 6 == 1 or (k % 6 == 0 and str(k)[0] == "7") else None

    assert got == {str(k): want(k) for k in keys if want(k)}
