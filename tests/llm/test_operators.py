"""Edge cases of every operator, and brute-force versions of those that SQL does not express."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import exact_dedup, langid, minhash, mixing, packing, quality_qda, quality_rules, toxicity, url_reputation, warc

LONG = "lorem ipsum dolor sit amet " * 6000
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong coffee near quiet rivers"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, n int, run string, label string, size string, copies string, __gone string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, "x", "x", 1, "x", "x", "x", "x", "x") for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE, "en", "a"), (2, PROSE.upper(), "en", "a"), (3, PROSE + " today", "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, LONG, "de", "b"), (6, LONG, "de", "b"), (7, " \n\t", "fr", "c"), (8, "12 34", "fr", "c"), (None, "no id here at all now", "en", "a"), (9, "one two", "en", "a"), (10, "one two", "en", "c")]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 11)] + [(1, 0, 0), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_langid_edges(docs):
    found = rows_of(langid.languages(docs))
    assert len(found) == 12
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (4, 5, 7, 8))
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.languages(docs.limit(0)).count() == 0
    untaught = rows_of(langid.predicted(docs, langid.fit(docs.limit(0))))
    assert {r["lang_pred"] for r in untaught} == {"und"}


def test_langid_backs_off_to_ngrams():
    seen = [("x", 0, "aaa", 5), ("y", 0, "bbb", 5), ("x", 2, "aa", 9), ("y", 2, "bb", 9), ("x", 1, "a", 9), ("y", 1, "b", 9)]
    model = langid.build(pa.table(dict(zip(("lang", "size", "term", "n"), map(list, zip(*seen, strict=True)), strict=True))))
    assert model.langs == ["x", "y"]
    assert model.word("aaa").argmax() == 0 and model.word("bb").argmax() == 1
    assert model.word("zaz").argmax() == 0  # no known pair of letters: single ones


def test_langid_learns_rare_languages(spark):
    """A language with a row in two thousand is read whole, however small the sample."""
    docs = spark.range(8000).selectExpr("id AS doc_id", "IF(id % 2000 = 7, 'zig zag zug', 'one two three') AS text", "IF(id % 2000 = 7, 'rare', 'common') AS lang")
    model = langid.fit(docs, 60, 20)
    assert model.langs == ["common", "rare"]
    assert model.word("zug").argmax() == 1 and model.word("two").argmax() == 0


def test_langid_against_brute_force(spark):
    """Counting, smoothing, backing off and adding up, restated with plain dictionaries over every training text."""
    rng = np.random.default_rng(12)
    sounds = {"aa": ["ka", "lo", "mi", "tu", "é"], "bb": ["sch", "ei", "nd", "lo", "ü"], "cc": ["zh", "ao", "ka", "nd", "x"]}
    rows = []
    for i in range(150):
        lang = sorted(sounds)[i % 3]
        words = ["".join(rng.choice(sounds[lang], rng.integers(1, 5))) for _ in range(rng.integers(1, 25))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words) + " 12!", lang if rng.random() < 0.9 else None))
    rows += [(150, "kalo Schei, mitu... QQ", None), (151, None, "aa"), (152, "77 --", "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    tokens = lambda t: ["".join(g) for g in _letter_runs(t.lower())]
    grams = lambda w, n: [m[i : i + n] for m in [f"<{w}>" if n > 1 else w] for i in range(len(m) - n + 1)]
    counts: dict[tuple[int, str], Counter] = {}
    for i, text, lang in rows:
        if lang and text and zlib.crc32(str(i).encode()) % 5:
            for w in tokens(text):
                for size in range(5):
                    for term in [w] if size == 0 else grams(w, size):
                        counts.setdefault((size, term), Counter())[lang] += 1
    langs = sorted({x for c in counts.values() for x in c})
    totals = {(size, x): sum(c[x] + 0.5 for (k, _), c in counts.items() if k == size) for size in range(5) for x in langs}

    def of_word(w, x):
        if (0, w) in counts:
            return np.log((counts[0, w][x] + 0.5) / totals[0, x])
        for n in (4, 3, 2, 1):
            known = [np.log((counts[n, g][x] + 0.5) / totals[n, x]) for g in grams(w, n) if (n, g) in counts]
            if known:
                return np.mean(known)
        return 0.0

    found = {r["doc_id"]: r for r in rows_of(langid.languages(docs))}
    for i, text, _ in rows:
        words = tokens(text or "")
        if not words:
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0)
            continue
        evidence = {x: sum(of_word(w, x) for w in words) for x in langs}
        best = max(evidence.values())
        assert evidence[found[i]["lang_pred"]] == pytest.approx(best)
        assert found[i]["score"] == pytest.approx(1 / sum(np.exp(e - best) for e in evidence.values()))


def _letter_runs(text):
    run = []
    for c in text:
        if c.isalpha():
            run.append(c)
        elif run:
            yield run
            run = []
    if run:
        yield run


def test_langid_model_is_sparse(spark):
    """Forty languages of words of their own: the model holds a term's own language only, and none is left out."""
    name = lambda k: chr(97 + k // 8) * 4 + chr(107 + k % 8) * 3
    docs = spark.createDataFrame([(i, f"w{name(i % 40)} z{name(i % 40)}", f"l{i % 40:02d}") for i in range(400)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 40 and len(model.terms[0].number) == 80 == len(model.terms[0].langs)
    assert all(model.word(f"w{name(k)}").argmax() == k for k in range(40))


def test_warc_links_and_digests(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", '<html lang="en"><head><title>T &amp; &#65;</title></head><p>one<br>two&#x42;<script>x</script></html>'), (2, None, None), (3, "x", "")], "page_id bigint, url string, html string")
    sources = warc.responses(pages)
    ids = {r["page_id"]: r for r in rows_of(sources)}
    made = rows_of(warc.derivatives(sources))
    assert len(made) == 6
    for r in made:
        assert r["refers_to"] == ids[r["page_id"]]["record_id"] and r["payload_digest"] == ids[r["page_id"]]["payload_digest"]
        assert r["content_length"] == len(r["block"].encode())
    text = next(r for r in made if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert text["block"] == "one\ntwoB"
    import base64
    import hashlib

    assert text["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"one\ntwoB").digest()).decode()
    assert "title: T & A\r\n" in next(r for r in made if r["page_id"] == 1 and r["record_type"] == "metadata")["block"]
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_edges(spark):
    """Very long pages, repeated rows, nulls in any column and clashing further columns."""
    long = "<p>" + "word " * 400_000
    rows = [(1, "http://a.b", long, "x", "x"), (1, "http://a.b", long, "x", "x"), (None, None, None, None, None), (2, "", "<b>t", "y", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, block string, record_id string")
    made = rows_of(warc.derivatives(warc.responses(pages)))
    assert Counter(r["page_id"] for r in made) == {1: 4, None: 2, 2: 2}
    texts = [r for r in made if r["page_id"] == 1 and r["record_type"] == "conversion"]
    assert len(texts) == 2 and texts[0] == texts[1] and len(texts[0]["block"]) == 5 * 400_000 - 1
    assert {r["block"] for r in made if r["page_id"] is None} == {"", "title: \r\nlanguage: \r\n"}


def test_url_rules_and_reputation(spark):
    urls = ["http://X.example.COM/en/7?q", "http://a.com/en/1", "https://b.net/de/9", "http://m.example.net/de/85", "http://o.org/es/", "http://notcom/en/", None, "no scheme", "http://fine.io#x", "http://[::1]:80/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    outcomes = spark.createDataFrame([(1, 1)], "key bigint, bad int")
    found = {r["page_id"]: r for r in rows_of(url_reputation.judged_pages(pages, outcomes))}
    assert len(found) == len(urls)
    assert [found[i]["rule"] for i in range(10)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None]
    assert [found[i]["verdict"] for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert found[0]["host"] == "x.example.com" and found[0]["path"] == "/en/7" and found[6]["host"] == "" and found[8]["path"] == ""
    assert url_reputation.judged_pages(pages.limit(0), outcomes).count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good' + str(i % 7)}.test/x/{i}") for i in range(200)], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(i, int(i < 60)) for i in range(200)], "key bigint, bad int")
    verdicts = {(r["host"][:3], r["verdict"]) for r in rows_of(url_reputation.judged_pages(pages, outcomes))}
    assert verdicts == {("bad", "block"), ("goo", "allow")}


def test_worse_hosts_are_blocked_at_any_base_rate(spark):
    """A host of twice the odds of all pages over many pages is blocked, one of few pages and one a little worse are not."""
    for base in (0.02, 0.15, 0.6):
        odds = 2.2 * base / (1 - base)
        rates = {"worse.test": odds / (1 + odds), "little.test": 1.02 * base} | {f"h{i}.test": base for i in range(20)}
        rows = [(h, int(i < round(r * 3000))) for h, r in rates.items() for i in range(3000)] + [("few.test", 1)] * 2
        judged = spark.createDataFrame(rows, "host string, bad int")
        found = {r["host"]: r for r in rows_of(url_reputation.host_reputation(judged).withColumn("worse", F.expr(url_reputation._worse("bound", "base", url_reputation.BLOCK_ODDS))))}
        assert {h for h, r in found.items() if r["worse"]} == {"worse.test"}


def test_lower_bound_against_beta_quantiles(spark):
    rng = np.random.default_rng(8)
    cases = [(0.0, 0.0, 5.0, 0.2), (3.0, 3.0, 2.0, 0.15), (12.0, 4.0, 20.0, 0.15), (2000.0, 300.0, 100.0, 0.1), (1.0, 0.0, 1.0, 0.5)]
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n double, k double, s double, mu double")
    for r in table.select("i", F.expr(url_reputation._BOUND).alias("b")).collect():
        n, k, s, mu = cases[r["i"]]
        draws = rng.beta(k + s * mu, n - k + s * (1 - mu), 200_000)
        assert 0.02 < (draws < r["b"]).mean() < 0.075  # 0.05 is asked for


def test_url_edges(spark):
    """Very long urls, repeated rows and clashing further columns change nothing."""
    long = "http://long.test/x/" + "a/" * 50_000
    rows = [(1, long, "x", 0.5), (1, long, "x", 0.5), (None, "http://long.test/y", None, None), (2, "", "z", 1.0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, bound double")
    found = rows_of(url_reputation.judged_pages(pages, spark.createDataFrame([(1, 1), (2, 0)], "key bigint, bad int")))
    assert sorted(map(str, (r["page_id"] for r in found))) == ["1", "1", "2", "None"]
    assert {r["host"] for r in found} == {"long.test", ""} and [r["path"] for r in found if r["page_id"] == 1] == [long[16:]] * 2


def test_quality_rules_edges(docs):
    found = rows_of(quality_rules.ledger(docs))
    assert len(found) == 12
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert by[4][0]["n_words"] == 0 and by[4][0]["fail_bits"] & 1
    assert by[6][0]["n_repeat_words"] == by[6][0]["n_words"] == 30000
    assert by[1][0]["fail_bits"] == 0
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_repeated_words_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        words = [bytes([97 + x]) for x in rng.integers(0, 4, rng.integers(0, 40))]
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        marked = {i + k for i in range(len(words) - 4) for k in range(5) if seen[tuple(words[i : i + 5])] > 1}
        assert quality_rules.repeated_words(words) == len(marked)


def test_exact_dedup(docs):
    found = rows_of(exact_dedup.exact_groups(docs))
    assert len(found) == 12
    by = {r["doc_id"]: r for r in found}
    assert by[1]["keep_id"] == by[2]["keep_id"] == 2 and by[1]["group_size"] == 2 and by[2]["kept"] and not by[1]["kept"]
    assert by[4]["text_sha256"] == by[5]["text_sha256"] and by[4]["keep_id"] == 5
    assert by[6]["group_size"] == 2 and by[9]["keep_id"] == 10
    left = exact_dedup.exact_distinct(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [2, 3, 5, 6, 6, 7, 8, 10]
    assert {r["keep_id"] for r in rows_of(exact_dedup.exact_groups(docs, keep="min")) if r["doc_id"] in (9, 10)} == {9}
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_distinct_digests_once(docs, spark):
    """Rows of one id: other texts, other cases, repeated; the plan that meets the texts again has no SHA-256 in it."""
    rows = [(1, "Ab"), (1, "aB"), (2, "x"), (1, "x"), (1, "y"), (3, "AB"), (None, "y"), (4, None), (4, ""), (2, "X"), (2, "x")]
    table = spark.createDataFrame([(*r, "raw") for r in rows], "doc_id bigint, text string, raw string")
    left = exact_dedup.exact_distinct(table)
    assert sorted(map(str, left.collect())) == sorted(map(str, table.where("(doc_id = 3) OR (doc_id = 2) OR (doc_id = 1 AND text = 'y') OR doc_id = 4").collect()))
    assert "sha2" not in left._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_merges_sorted_runs(docs):
    """Every fold runs in sort order, no hash table holds digests, and the rounds need no exchange of their own."""
    rows = docs.select("doc_id", *exact_dedup.digest_columns(F.col("text"))).repartition(5)
    plan = exact_dedup.merged_runs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 2
    want = {}
    for r in docs.collect():
        want.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""), []).append(r.doc_id)
    for keep, best in (("max", max), ("min", min)):
        found = sorted((r["keep_id"] is None, r["keep_id"], r["group_size"]) for r in rows_of(exact_dedup.merged_runs(rows, keep)))
        ids = [([i for i in g if i is not None], len(g)) for g in want.values()]
        assert found == sorted((not i, best(i) if i else None, n) for i, n in ids)


def test_minhash_edges(docs):
    found = rows_of(minhash.near_components(docs))
    assert len(found) == 12
    by = {r["doc_id"]: r for r in found}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["n_shingles"] == by[7]["n_shingles"] == 0 and by[4]["component_id"] == 4 and by[4]["kept"]
    assert by[9]["component_id"] == by[10]["component_id"] == 9 and by[9]["n_shingles"] == 1
    left = minhash.near_distinct(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 4, 5, 6, 7, 8, 9, None}
    assert minhash.near_components(docs.limit(0)).count() == 0


def test_minhash_against_brute_force(spark):
    rng = np.random.default_rng(7)
    bases = [[f"w{x}" for x in rng.integers(0, 3000, rng.integers(3, 90))] for _ in range(12)]
    texts = []
    for _ in range(260):
        words = list(bases[rng.integers(len(bases))])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(len(words))] = f"x{rng.integers(5000)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    found = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_components(docs))}
    assert found == {i: top(i) for i in range(len(texts))}


def test_unsettled_blocks_find_links_between_components(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "z"]), " ".join([*words, "z", "y"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    signed = minhash.signatures(docs)
    classes = signed.selectExpr("n", "mark", "doc_id AS class_id", "bands")
    members = classes.select("class_id", F.posexplode("bands").alias("band", "key"))
    none = spark.createDataFrame([], "node bigint, root bigint")
    blocks = minhash._unsettled(members, classes, none)
    links = {tuple(sorted((r["a"], r["b"]))) for r in rows_of(minhash.verified_blocks(blocks, docs, "test"))}
    reached = {0}
    for _ in range(3):
        reached |= {x for link in links if set(link) & reached for x in link}
    assert reached == {0, 1, 2}


def test_collision_correction_is_unbiased():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        got = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            both = int(2000 * share)
            extra = (2000 - both) // 2
            a, b = np.unique(pool[: both + extra]), np.unique(np.concatenate([pool[:both], pool[both + extra : both + 2 * extra]]))
            got.append(float(minhash.estimate(minhash.signature(a), minhash.signature(b), np.array(len(a)), np.array(len(b)))))
        assert abs(np.mean(got) - share) < 0.03


def test_ablations_against_brute_force(spark):
    bits = [int(x) for x in np.random.default_rng(4).integers(0, 1 << len(quality_rules.RULES), 300)] + [0, 0, 1, 2, 4]
    book = spark.createDataFrame([(b,) for b in bits], "fail_bits bigint")
    for policy, force in quality_rules.POLICIES.items():
        want = {}
        for i, name in enumerate(quality_rules.RULES):
            if force >> i & 1:
                mine = [b & force for b in bits]
                want[name] = (sum(b >> i & 1 for b in mine), mine.count(1 << i), mine.count(0), sum(not b & ~(1 << i) for b in mine))
        found = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept"], r["n_kept_without"]) for r in rows_of(quality_rules.ablations(book, policy))}
        assert found == want


def test_write_warc_and_buckets(spark, docs, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a.b/c", "<title>é</title><p>one<br>two"), (2, None, None), (3, "http://a.b/\r\nWARC-Type: bad", "long " * 100_000)], "page_id bigint, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    warc.write_warc(records.repartition(2), str(tmp_path / "warc"))
    found = []
    for file in (tmp_path / "warc").glob("*.warc.gz"):
        raw = file.read_bytes()
        while raw:  # a gzip member per record, each a whole record and nothing else
            member = zlib.decompressobj(wbits=31)
            record, raw = member.decompress(raw), member.unused_data
            head, rest = record.split(b"\r\n\r\n", 1)
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            length = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.0\r\nWARC-Type: ") and rest[length:] == b"\r\n\r\n"
            found.append((fields[b"WARC-Record-ID"].decode()[1:-1], fields[b"WARC-Type"].decode(), rest[:length].decode()))
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.0")
    assert sorted(found) == sorted((r["record_id"], r["record_type"], r["block"]) for r in rows_of(records))
    pieces = packing.packed(docs)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert sorted(map(str, back.select("doc_id", "start", "length").collect())) == sorted(map(str, pieces.selectExpr("doc_id", "start", "length").collect()))
    assert all(len(r["ids"]) % r["length"] == 0 for r in rows_of(back))
    want = Counter(r["length"] for r in rows_of(pieces))
    assert {r["length"]: r["sequences"] for r in rows_of(packing.buckets(pieces))} == want
    assert sum(r["documents_ended"] for r in rows_of(packing.buckets(pieces))) == docs.count()


def test_toxicity_trie():
    trie = toxicity.Trie(["moron", "idiot*", "disgusting"])
    assert trie.match("moron") == (0, 0) and trie.match("idiots") == (0, 1)
    assert trie.match("m0ron") == (1, 0) and trie.match("disgustin") == (1, 2) and trie.match("disqustlng") == (2, 2)
    assert trie.match("oron") == (1, 0) and trie.match("river") is None and trie.match("idi0t") == (1, 1)


def test_toxicity_misspellings():
    trie = toxicity.Trie(["idiot*", "moron*", "clown", "loser*", "trash*", "scum*", "stupid", "pathetic", "oaf"])
    wrong = "idot morn clwn losr trsh skum scuum idoit tarsh stupdi 1diot $tupid athetic omron idoits".split()
    assert [w for w in wrong if (trie.match(w) or (0,))[0] != 1] == []
    assert trie.match("oad") is None and toxicity.Trie(["disgusting"]).match("a") is None and trie.match("oron") == (1, 1) and trie.match("stpd") is None
    terms = toxicity.Matcher(["moron", "clown"], innocent=frozenset({"crown", "oron"}))
    assert [w for w in ("moroon", "crown", "clovn", "oron", "lown") if terms.hits([w])] == ["moroon", "clovn", "lown"]


def test_toxicity_automaton_against_brute_force():
    def osa(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = np.random.default_rng(2)
    make = lambda low, high: "".join(rng.choice(list("abc"), rng.integers(low, high)))
    terms = sorted({make(3, 11) for _ in range(12)})
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        word = make(2, 12)
        near = [n for t in terms if (n := osa(t, word)) <= toxicity.edits_allowed(len(t))]
        assert (trie.match(word) or (None,))[0] == min(near, default=None)


def test_toxicity_scores_against_brute_force(spark, docs):
    """Matches by plain edit distance over all terms, windows, features and scores restated; only the weights are given."""
    terms, reporting, innocent = ["moron", "idiot*", "scum*", "disgusting"], frozenset({"said", "wrote"}), frozenset({"maroon"})
    weights = np.array([1.5, 0.7, 3.0, 0.4, -0.3, -0.8, -0.1, -1.0])
    rng = np.random.default_rng(13)
    pool = ["river", "stone", "maroon", "moron", "morn", "m0ron", "idiots", "ideot", "scumbag", "skum", "disgustin", "disqustlng", "said", '"', ".", "oron", "İdiot", "blue"]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 60), p=[0.2, 0.2] + [0.6 / 16] * 16)) for _ in range(120)] + ["", None, "x " * 20000 + "you moron"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in rows_of(toxicity.scored(table, toxicity.Model(terms, reporting, innocent, weights)))}

    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    def match(word):
        """(edits, term) or None."""
        whole = [(0, t) for t in terms if word == t or (t[-1] == "*" and word.startswith(t[:-1]))]
        if whole:
            return whole[0]
        near = []
        for t in terms:
            body = t.rstrip("*")
            if distance(body, word) <= (0 if len(body) < 4 else 1 if len(body) < 9 else 2):
                near.append((distance(body, word), t))
            if t[-1] == "*" and len(word) > len(body) >= 5 and min(distance(body, word[:k]) for k in range(len(word) + 1)) <= 1:
                near.append((1, t))
        return None if not near or word in innocent else min(near)

    import re

    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        spans = [(m.start(), m.end()) for m in re.finditer(r"(?:[\w@$](?<!_)|[\u0300-\u036f])+", lowered)]
        words = [lowered[a:b] for a, b in spans]
        known = {w: match(w) for w in set(words)}
        hits = [(k, *known[w]) for k, w in enumerate(words) if known[w]]
        direct = wrong = quoted = 0
        kinds = set()
        for k, edits, term in hits:
            low, high = max(0, k - 6), min(len(words), k + 7)
            said = any(w in reporting for w in words[low:high])
            quotes = lambda part: any(q in part for q in toxicity._QUOTES)
            said = said or (quotes(lowered[max(0, spans[low][0] - 1) : spans[k][0]]) and quotes(lowered[spans[k][1] : spans[high - 1][1] + 1]))
            if said:
                quoted += 1
            else:
                direct, wrong, kinds = direct + 1, wrong + (edits > 0), kinds | {term}
        x = [direct > 0, np.log1p(direct), np.sqrt(direct / max(len(words), 1)), np.log1p(len(kinds)), np.log1p(wrong), np.log1p(quoted), np.log1p(len(words))]
        assert found[i] == pytest.approx(1 / (1 + np.exp(-(np.dot(x, weights[:-1]) + weights[-1])))), text


def test_toxicity_weights_are_the_penalised_optimum():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(400, len(toxicity.FEATURES)))
    y = (x @ rng.normal(size=x.shape[1]) + rng.normal(size=400) > 0.5).astype(float)
    w = toxicity.logistic(x, y)
    ridge = np.full(len(w), 0.3)
    ridge[-1], ridge[toxicity.FEATURES.index("misspelled")] = 1e-6, 6.0
    z = np.hstack([x, np.ones((400, 1))])
    assert np.abs(z.T @ (y - 1 / (1 + np.exp(-z @ w))) - ridge * w).max() < 1e-5


def test_toxicity_quotation_and_edges(spark, docs, labels):
    matcher = toxicity.Matcher(["moron", "idiot*"])
    plain, quoted = matcher.features("you are a moron and an idiot"), matcher.features('she said "you are a moron and an idiot" again')
    assert plain[0] == 1 and quoted[0] == 0 and quoted[toxicity.FEATURES.index("quoted")] > 0
    found = rows_of(toxicity.toxicity_scores(docs, labels))
    assert len(found) == 12 and all(0 <= r["score"] <= 1 for r in found)
    assert rows_of(toxicity.toxicity_scores(docs, labels.limit(0)))[0]["score"] == 0
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_toxicity_learns(spark):
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(400):
        words = [f"word{x}" for x in rng.integers(0, 400, 40)]
        bad = i % 4 == 0
        for k in rng.integers(0, 40, 4) if bad else []:
            words[k] = ["grumbug", "snorfle", "blathor"][rng.integers(3)]
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    score = {r["doc_id"]: r["score"] for r in rows_of(toxicity.toxicity_scores(docs, labels))}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(score[i] >= 0.7) == (i % 4 == 0) for i in held]
    assert np.mean(right) > 0.95


def test_toxicity_learns_a_long_tail(spark):
    """80 terms, each in about one in eighty toxic texts: below 1.5 %, and in no other text."""
    rng = np.random.default_rng(6)
    terms = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 8)) for _ in range(80)]
    rows = [(i, " ".join([f"word{x}" for x in rng.integers(0, 400, 10)] + ([terms[i // 3 % 80]] if i % 3 == 0 else []))) for i in range(4800)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(4800)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, toxicity.train_rows())
    trie = toxicity.Trie(model.terms)
    assert sum(trie.match(t) is not None and trie.match(t)[0] == 0 for t in terms) >= 70
    assert not any(trie.match(f"word{x}") for x in range(400))


def test_packing_round_trip(docs):
    from pathlib import Path

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(Path(public_tokenizers.path("byte_bpe_50k.json"))))
    found = packing.packed(docs.where("doc_id <> 6")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    for key, pieces in by.items():
        ids = [i for p in sorted(pieces, key=lambda p: p.start) for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids == [*tokenizer.encode(texts[key], add_special_tokens=False).ids, 0]
        assert all(p.length & (p.length - 1) == 0 and p.length <= 1024 and p.offset == 0 for p in pieces)
    assert len({r.sequence_id for r in found}) == len(found)
    assert packing.packed(docs.where("doc_id = 6")).groupBy("doc_id").agg(F.sum("length")).count() == 1
    assert packing.packed(docs.limit(0)).count() == 0
    for odd in ("a  b", "a \n\n b", "x　　y ", "  ", "it's 12  ok\x1c\x1c!", "hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>  b\n\n", "<|endoftext|", "x <|endoftext|>|> y"):
        assert packing.encoder(packing.default_vocabulary())(odd).tolist() == tokenizer.encode(odd, add_special_tokens=False).ids


def test_quality_edges_and_accuracy(spark, docs, labels):
    found = rows_of(quality_qda.quality_scores(docs, labels))
    assert len(found) == 12 and all(0 <= r["score"] <= 1 for r in found)
    assert rows_of(quality_qda.quality_scores(docs, labels.limit(0)))[0]["score"] == 0.5
    left = quality_qda.kept_by_quality(docs, labels.limit(0))
    assert left.columns == docs.columns and left.count() == 12
    assert quality_qda.quality_scores(docs.limit(0), labels).count() == 0
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(("word%d" % x).upper() + "!!" if i % 5 == 0 else "word%d" % x for x in rng.integers(0, 500, 60))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(300)], "doc_id bigint, quality int")
    score = {r["doc_id"]: r["score"] for r in rows_of(quality_qda.quality_scores(table, marks))}
    assert np.mean([(score[i] >= 0.3) == (i % 5 != 0) for i in range(300)]) > 0.98


def test_qda_against_plain_numpy(spark):
    """Statistics, fit and scores restated row by row from the texts, with dense inverses and determinants."""
    rng = np.random.default_rng(4)
    texts = []
    for i in range(160):
        words = [f"word{x}" for x in rng.integers(0, 60, rng.integers(1, 50))]
        if i % 3 == 0:
            words = [w.upper() + "!" * int(rng.integers(0, 3)) if rng.random() < 0.5 else w + "." for w in words]
        texts.append(" ".join(words) + ("\n" + words[0]) * int(rng.integers(0, 3)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = {i: int(i % 3 != 0) for i in range(140)}
    labels = spark.createDataFrame(list(marks.items()), "doc_id bigint, quality int")
    x = np.array([quality_qda.text_statistics(t.encode()) for t in texts])
    for i, text in enumerate(texts):  # a few statistics by hand
        words, lines = text.split(), text.split("\n")
        assert x[i, 0] == pytest.approx(np.log(1 + len(words))) and x[i, 3] == pytest.approx(np.log(len(set(words)) / len(words)))
        assert x[i, 11] == pytest.approx(np.sqrt(1 - len(set(lines)) / len(lines)))
    train = [i for i in marks if zlib.crc32(str(i).encode()) % 5 != 0]
    sizes = np.array([len(t.split()) for t in texts])
    center = x[train].mean(axis=0)
    u = (sizes / (sizes + 8))[:, None] * (x - center)
    groups = [u[[i for i in train if marks[i] == c]] for c in (0, 1)]
    covs = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / len(train)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    logs = []
    for g, c in zip(groups, covs, strict=True):
        c = (0.8 * c + 0.2 * pooled) / np.outer(scale, scale)
        c = 0.95 * c + 0.05 * np.trace(c) / len(c) * np.eye(len(c))
        off = (u - g.mean(axis=0)) / scale
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(c), off) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(g)))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -60, 60)))
    got = {r["doc_id"]: r["score"] for r in rows_of(quality_qda.quality_scores(docs, labels))}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-6)


def test_mixing_targets_and_totals(spark, docs):
    plan = rows_of(mixing.copies(docs))
    assert len(plan) == 12 and all(0 <= r["copies"] <= 3 for r in plan)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.copies(docs.limit(0)).count() == 0
    again = Counter(tuple(sorted(r.items(), key=str)) for r in rows_of(mixing.copies(docs.repartition(3))))
    assert again == Counter(tuple(sorted(r.items(), key=str)) for r in plan)


def test_mixing_water_filling_against_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{int(rng.integers(0, 9)) ** 2 % 11:02d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(size))}
    total, target, free = sum(size.values()), {}, set(size)
    while True:
        rest = total - sum(target.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 3 * size[s]}
        if not over:
            target |= level
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    taken, found = Counter(), {}
    for r in rows_of(mixing.copies(docs)):
        taken[r["source"]] += r["copies"] * r["size"]
        found[r["source"]] = r["target"]
    assert found == pytest.approx(target)
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
