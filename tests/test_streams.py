"""Streams over several batches: ids in flight across restarts, repairs of scores, long runs with figures."""

import re
import time


from tickerloom.functions import newstext as X
from tickerloom.functions.newstext import SECTORS
from tickerloom.plans import stream_queries
from tickerloom.streaming import ingest
from tickerloom.streaming.figures import figures
from tickerloom.streaming.repair import open_repairs, scored

NOW = 1_700_000_000


def land(spark, source, *rows):
    full = [(i, ts, src, "", content, [], score, [], sectors) for i, ts, src, content, score, sectors in rows]
    spark.createDataFrame(full, ingest.NEWS_SCHEMA).coalesce(1).write.mode("append").parquet(source)


def story(i, ts=NOW, src="cls", score=5, sectors=None):
    return (i, ts, src, f"a long enough story that only {i} tells", score, sectors)


def paths(tmp_path):
    return tuple(str(tmp_path / x) for x in ("in", "store", "check"))


def ids(spark, store):
    return sorted(r.event_id for r in spark.read.schema(ingest.NEWS_SCHEMA + ", batch int").parquet(f"{store}/rows").collect())


def test_guarded_ids_across_batches_and_a_restart(spark, tmp_path, monkeypatch):
    source, store, checkpoint = paths(tmp_path)
    # Without the look-up of stored ids the guard alone has to tell.
    monkeypatch.setattr(ingest, "new_events_only", lambda incoming, stored: incoming)
    land(spark, source, story("a"), story("b"), story("a"))
    ingest.start(spark, source, store, checkpoint, guard_s=3600).awaitTermination(120)
    land(spark, source, story("a", NOW + 1), story("c", NOW + 1))

    def crash(*_, **__):
        raise RuntimeError("lost in mid-batch")

    monkeypatch.setattr(ingest, "greedy", crash)
    try:
        ingest.start(spark, source, store, checkpoint, guard_s=3600).awaitTermination(120)
    except Exception as e:
        assert "lost in mid-batch" in str(e)
    monkeypatch.undo()
    monkeypatch.setattr(ingest, "new_events_only", lambda incoming, stored: incoming)
    land(spark, source, story("b", NOW + 2), story("c", NOW + 2), story("d", NOW + 2))
    ingest.start(spark, source, store, checkpoint, guard_s=3600).awaitTermination(120)
    assert ids(spark, store) == ["a", "b", "c", "d"]


def test_guarded_ids_leave_the_state(spark, tmp_path):
    source, store, checkpoint = paths(tmp_path)
    for k in range(4):
        land(spark, source, *[story(f"{k}-{i}", NOW + k) for i in range(20)])
        ingest.start(spark, source, store, checkpoint, guard_s=0).awaitTermination(120)
        time.sleep(0.1)
    assert len(ids(spark, store)) == 80
    # A batch's ids stay until the watermark has passed them, one batch later.
    assert max(r.guarded_ids for r in figures(spark, f"{store}/figures").collect()) <= 40


def test_a_second_answer_repairs_the_first(spark, tmp_path):
    source, store, checkpoint = paths(tmp_path)

    def scorer(batches):
        for rows in batches:
            wrong = rows["event_id"].str.startswith("wrong")
            yield rows.assign(score=[0 if w else 50 for w in wrong], sectors=[[SECTORS[0]] if not i.startswith("odd") else ["nowhere"] for i in rows["event_id"]])

    def repairer(batches):
        for rows in batches:
            if rows["event_id"].str.contains("fails").any():
                raise ValueError("no answer")
            yield rows.assign(score=[0 if i.startswith("wrong2") else 60 for i in rows["event_id"]], sectors=[[SECTORS[1]]] * len(rows))

    land(spark, source, *[story(i) for i in ("right", "wrong1", "wrong2", "odd", "wrong-fails")])
    ingest.start(spark, source, store, checkpoint, scorer=scorer, repairer=repairer, attempts=2).awaitTermination(120)
    rows = {r.event_id: (r.score, r.sectors) for r in spark.read.schema(ingest.NEWS_SCHEMA).parquet(f"{store}/rows/batch=0").collect()}
    assert rows == {"right": (50, [SECTORS[0]]), "wrong1": (60, [SECTORS[1]]), "odd": (60, [SECTORS[1]]), "wrong2": (0, [SECTORS[1]]), "wrong-fails": (0, None)}
    queue = spark.read.schema(ingest.QUEUE_SCHEMA).parquet(f"{store}/repairs/batch=0")
    assert sorted((r.event_id, r.attempt, r.open) for r in queue.collect()) == [("odd", 1, False), ("wrong-fails", 1, False), ("wrong1", 1, False), ("wrong2", 1, True), ("wrong2", 2, True)]
    assert [tuple(r) for r in open_repairs(queue).collect()] == [("wrong2", 2, 0, [SECTORS[1]])]


def test_a_long_run_writes_figures_and_clears_its_source(spark, tmp_path):
    source, store, checkpoint = paths(tmp_path)
    archive = str(tmp_path / "done")
    land(spark, source, story("a"), story("b", NOW + 1, "jin10"))
    query = ingest.start(spark, source, store, checkpoint, every="1 second", archive=archive, files_per_batch=1)
    try:
        for k, rows in enumerate([(), (story("c", NOW + 2), story("a", NOW + 2)), (story("d", NOW - 9), story("e", NOW + 3))]):
            if rows:
                land(spark, source, *rows)
            for _ in range(300):
                if figures(spark, f"{store}/figures").count() > k:
                    break
                time.sleep(0.2)
    finally:
        query.stop()
    got = [(r.batch, r.landed, r.sources, r.oldest, r.newest, r.stored) for r in figures(spark, f"{store}/figures").orderBy("batch").collect()]
    assert got == [(0, 2, 2, NOW, NOW + 1, 2), (1, 2, 1, NOW + 2, NOW + 2, 1), (2, 2, 1, NOW - 9, NOW + 3, 1)]
    assert ids(spark, store) == ["a", "b", "c", "e"]
    assert all(r.duration_ms > 0 for r in figures(spark, f"{store}/figures").collect())
    assert list((tmp_path / "done").rglob("*.parquet"))


def test_a_landing_is_written_by_several_tasks(spark, monkeypatch):
    class Done:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(stream_queries, "start", lambda *args, **how: Done())
    store = stream_queries._streamed(spark, "/root/testdata/sf0.001")
    files = len(spark.read.parquet(store.removesuffix("store") + "in").inputFiles())
    assert 2 < files <= 2 * 50


def test_whether_an_answer_needs_repair_is_worked_out_once(spark):
    """The results hold written columns only; no word of an event is looked for again in a later round."""
    rows = spark.createDataFrame([(str(i), NOW, "cls", "", f"收储 story {i}", [], 0, [], None) for i in range(20)], ingest.NEWS_SCHEMA)
    done, queue = scored(rows, stream_queries._first, stream_queries._second, attempts=2)
    for frame in (done, queue):
        assert "收储" not in frame._jdf.queryExecution().optimizedPlan().toString()
    # A strong event is scored too weakly by every attempt.
    assert done.count() == 20 and {(r.attempt, r.open) for r in queue.collect()} == {(1, True), (2, True)}


def test_words_are_found_as_by_looking_for_each():
    words = (*X.SECTORS, *X.ALIASES, *X.POSITIVE, *X.NEGATIVE, *X.HARD_EVENTS, *X.OFFICIAL)
    for group in (words, X.OFFICIAL, X.HARD_EVENTS):
        for text in ("", "a b c 12", "CXO", "cx", "IT服务", "IT 服务", "ＩＴ", "一", *words, *["x" + w[:-1] for w in words]):
            assert bool(re.search(X.any_of(group), text)) == any(w in text for w in group)
    assert not [w for w in words if re.escape(w) != w]
