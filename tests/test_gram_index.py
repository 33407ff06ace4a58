"""Keyword search by trigram lists: the rows of a scan, and the files that are read for them."""

import random
import re

import pytest

from tickerloom.operators import search
from tickerloom.operators import gram_index
from tickerloom.operators.gram_index import GramIndex, bucket_of, grams_of, needed_grams
from tickerloom.operators.store import NEWS_TABLE
from tickerloom.sources.versioned import VersionedTable

DAY = 86400
SCHEMA = "event_id string, publish_ts bigint, source string, title string, content string, score int, sectors array<string>"
PATTERNS = ["needle", "NEEDLE", "ab", "ne+dle", "nee?dle", "ne.dle", "needle|hay", "(needle)", "étoile", "STRASSE", "straße", "农业生产", "业生产", r"a\.b\.c", r"\d{3}", "x{2}yz", "[ht]ay", "nothing here", "needle$", "İst", "hay hay"]
TEXTS = ["a needle in the hay", "Needle", "NEDLE", "nedle", "neeeedle hay", "no such", "ÉTOILE filante", "straße", "STRASSE", "中国农业生产", "a.b.c", "aXbXc", "call 123", "xxyz", "xyz", "stay", "İstanbul", "istanbul", "hay\nhay", "", None, "ha", "hay hay hay"]


def news(spark, rows):
    return spark.createDataFrame([(f"{i:05d}", ts, "cls", title, content, i % 100, ["A"]) for i, ts, title, content in rows], SCHEMA)


@pytest.fixture
def stored(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, (i % 6) * DAY + i, rng.choice(TEXTS), rng.choice(TEXTS)) for i in range(300)] + [(900, 2 * DAY, "only here: quixotic", "")]
    table = VersionedTable(spark, f"file://{tmp_path}/news", **NEWS_TABLE)
    table.merge(news(spark, rows))
    return table, GramIndex(table, f"file://{tmp_path}/grams"), rows


def ids(frame):
    return {r.event_id for r in frame.select("event_id").collect()}


def test_grams_a_pattern_needs():
    assert needed_grams("needle") == {"nee", "eed", "edl", "dle"} == needed_grams("NEEDLE")
    assert needed_grams("needles?") == {"nee", "eed", "edl", "dle"} and needed_grams("a.bcd+ef") == {"bcd"}
    assert needed_grams("abc{2}de") == set() == needed_grams("abc|abd") == needed_grams("ab") == needed_grams(r"abc\d") == needed_grams("(abc)")
    assert needed_grams(r"a\.bc") == {"a.b", ".bc"} and needed_grams("abc[x-z]def") == {"abc", "def"} and needed_grams("abc[") == set()
    for pattern in PATTERNS:
        for text in filter(None, TEXTS):
            if re.search(pattern, text, re.IGNORECASE):
                assert needed_grams(pattern) <= grams_of(text), (pattern, text)


def test_search_finds_what_a_scan_finds(spark, stored):
    table, index, _ = stored
    found = {}
    for r in index.search_many(PATTERNS).select("pattern", "event_id").collect():
        assert r.event_id not in found.setdefault(r.pattern, set())
        found[r.pattern].add(r.event_id)
    for pattern in PATTERNS:
        assert found.get(pattern, set()) == ids(search.filtered(table.read(), keyword=pattern)), pattern
    assert ids(index.search("needle", min_score=40, source="cls")) == ids(search.filtered(table.read(), keyword="needle", min_score=40, source="cls"))


def test_only_the_files_of_needed_grams_and_candidates_are_read(spark, stored):
    table, index, _ = stored
    hits = index.search("quixotic")
    assert ids(hits) == {"00900"}
    files = [f for f in hits.inputFiles() if "/news/" in f]
    assert len(files) == 1 and "__part=1970-01-03" in files[0]
    lists = index.lists(needed_grams("quixotic"))
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in lists.inputFiles()} <= {bucket_of(g) for g in needed_grams("quixotic")}
    assert index.search_many(["quixotry"]).count() == 0 and not index.candidates(["quixotry"]).inputFiles()


def test_a_merge_is_indexed_by_what_it_rewrote(spark, stored):
    table, index, rows = stored
    assert index.refresh() == 6 and index.refresh() == 0
    table.merge(news(spark, [(900, 2 * DAY, "nothing now", ""), (901, 9 * DAY, "quixotic again", "")]))
    assert index.refresh() == 2
    assert ids(index.search("quixotic")) == {"00901"}
    for i in range(4):
        table.merge(news(spark, [(j, ts, f"rewritten {i}", "") for j, ts, _, _ in rows[:6]]))
    assert ids(index.search("rewritten")) == {f"{j:05d}" for j in range(6)} == ids(search.filtered(table.read(), keyword="rewritten 3"))


def test_an_empty_table_finds_nothing(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/news", **NEWS_TABLE)
    table.merge(news(spark, []))
    assert GramIndex(table, f"file://{tmp_path}/grams").search_many(["needle", "a|b"]).collect() == []


def test_long_lists_are_cut_into_chunks(spark, tmp_path, monkeypatch):
    from tickerloom.operators import gram_index

    monkeypatch.setattr(gram_index, "CHUNK_ROWS", 10)
    table = VersionedTable(spark, f"file://{tmp_path}/news", **NEWS_TABLE)
    table.merge(news(spark, [(i, 5, "common words", None) for i in range(200)]))
    index = GramIndex(table, f"file://{tmp_path}/grams")
    assert len(ids(index.search("common"))) == 200
    assert max(r.n for r in index.lists({"com"}).collect()) < 40


def test_lists_are_dealt_once(spark):
    parts = spark.createDataFrame([("f", 0, 3, "abc", 1, ["1"]), ("f", 0, 3, "abc", 2, ["2", "3"]), ("f", 1, 3, "abc", 1, ["4"])], gram_index._LISTS)
    whole = gram_index._whole_lists(parts)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.chunk, r.n, sorted(r.ids)) for r in whole.collect()) == [(0, 3, ["1", "2", "3"]), (1, 1, ["4"])]
