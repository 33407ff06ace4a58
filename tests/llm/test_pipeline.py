"""The pipeline on a small corpus, stage by stage against brute-force versions."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tickerloom.llm import mixing, packing, quality_qda


def test_stages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    texts = []
    for i in range(240):
        words = [f"word{x}" for x in rng.integers(0, 900, rng.integers(12, 60))]
        if i % 6 == 0:
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
    texts += [texts[i].title() for i in range(1, 40, 3)] + [texts[i] + " tail" for i in range(2, 40, 3)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 240, 2)] + [(i, 1, 0) for i in range(1, 240, 6)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None

    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, after = docs.collect(), stage(spark, docs, folder)
        assert after.columns == docs.columns
        path = f"{folder}/{name.replace(' ', '-')}"
        after.write.parquet(path)
        kept[name] = before
        docs = spark.read.parquet(path)
    kept["end"] = docs.collect()
    ids = {n: [r.doc_id for r in rows] for n, rows in kept.items()}
    of = {n: {r.doc_id: r for r in rows} for n, rows in kept.items()}

    scores = {r.doc_id: r.score for r in quality_qda.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    assert sorted(ids["exact dedup"]) == sorted(i for i, s in scores.items() if s >= quality_qda.THRESHOLD)
    assert not {i for i in ids["exact dedup"] if i < 240 and i % 6 == 0}

    best = {}
    for i, r in of["exact dedup"].items():
        best[r.text.lower()] = max(i, best.get(r.text.lower(), -1))
    assert sorted(ids["near dedup"]) == sorted(best.values())

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, r.text.lower().split()) for i, r in of["near dedup"].items())}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(ids["source mixing"]) == sorted({top(i) for i in sets})

    size = {i: len(r.text.split()) for i, r in of["source mixing"].items()}
    plan = mixing.copies(spark.read.parquet(f"{folder}/near-dedup")).collect()
    assert Counter(ids["end"]) == Counter({r.doc_id: r["copies"] for r in plan if r["copies"]})
    taken, target = Counter(), {r.source: r.target for r in plan}
    for i in ids["end"]:
        taken[of["source mixing"][i].source] += size[i]
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in target)

    encode, pieces = packing.encoder(packing.default_vocabulary()), defaultdict(int)
    for r in corpus_pipeline.STAGES[4][1](spark, docs, folder).collect():
        pieces[r.doc_id] += r.length
        assert r.length & (r.length - 1) == 0
    times = Counter(ids["end"])
    assert pieces == {i: times[i] * (len(encode(of["end"][i].text)) + 1) for i in times}


def test_run_on_edge_rows_is_its_stages_one_after_another(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeats and clashing columns; expected rows from plain Python."""
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 500, n))
    long, one = prose(30_000), prose(40)
    texts = [prose(int(rng.integers(20, 60))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", i, "y") for i, t in enumerate(texts)]
    rows += [(60, None, None, None, None, None, None, None), (61, "", "en", "s1", 0, "x", 1, "y"), (62, " \n", "en", "s1", 2, "x", 1, "y")]
    rows += [(63, long, "en", None, None, "x", 1, "y"), (64, one, "en", "s0", 1, "x", 1, "y"), (64, one, "en", "s0", 1, "x", 1, "y"), (65, one.upper(), "en", "s0", 1, "x", 1, "y"), (66, one + " end", "en", "s2", 1, "x", 1, "y")]
    rows += [(None, prose(30), "en", "s0", 1, "x", 1, "y"), (None, prose(30), None, "s0", 1, "x", 1, "y")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size int, kept string"
    folder = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    # Without a second class of labels every document has the same score and stays: what follows is exact.
    spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    shown = lambda k: sorted((str(r.doc_id) for r in spark.read.parquet(f"{tmp_path}/stage{k}").collect()))
    ids = [str(r[0]) for r in rows]
    assert shown(0) == sorted(ids)
    assert shown(1) == sorted([*ids[:60], "61", "62", "63", "65", "66", "None", "None"])  # null text is equal to the empty one; 65 is the largest of its text
    assert shown(2) == sorted([*ids[:60], "61", "62", "63", "65", "None", "None"])
    plan = mixing.copies(spark.read.parquet(f"{tmp_path}/stage2")).collect()
    assert Counter(shown(3)) == sum((Counter({str(r["doc_id"]): r["copies"]}) for r in plan), Counter())
    for source in ("s0", "s1", "s2", None):
        of = [r for r in plan if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in of) - of[0]["target"]) <= max(r["size"] for r in of)

    encode, mixed = packing.encoder(packing.default_vocabulary()), Counter()
    for r in spark.read.parquet(f"{tmp_path}/stage3").collect():
        mixed[str(r.doc_id)] += len(encode(r.text)) + 1
    found = corpus_pipeline.run(spark, folder).collect()
    packed = Counter()
    for r in found:
        packed[str(r.doc_id)] += r.length
        assert r.length & (r.length - 1) == 0 and 0 < r.length <= 1024 and r.offset == 0
    assert packed == mixed and len({r.sequence_id for r in found}) == len(found)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
