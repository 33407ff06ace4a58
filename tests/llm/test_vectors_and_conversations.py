"""Vector codes, nearest neighbours and conversation repair against plain versions, on planted and random rows."""

import hashlib
import heapq
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import conversation_repair, neighbours, vector_codes

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int, v string, ids string, part int")


def clustered(n, dims, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return (centres[rng.integers(0, 12, n)] + rng.normal(scale=spread, size=(n, dims))).astype(np.float32)


# ---- vector codes ----


def plain_codes(rows, rounds=6, entries=16):
    """{(vec_id, code, error, label_error)} counts and the fingerprint, by comparing everything."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    width = len(kept[0][1]) // 8
    books = [[min(v for i, v, _ in kept if i == one)[p * width : (p + 1) * width] for one in ids] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width]
                groups.setdefault(nearest(part, books[p])[1], []).append(part)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else entry for k, entry in enumerate(books[p])]
    out, sums = [], {}
    for i, v, lab in kept:
        found = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((i, c, e, sums[lab]) for i, c, e, lab in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def code_rows(frame):
    rows = vector_codes.vector_codes(frame).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=str), {r.codebooks_sha256 for r in rows}


@pytest.mark.parametrize(("n", "dims", "spread"), [(300, 16, 0.02), (90, 24, 0.5), (7, 8, 1.0)])
def test_vector_codes_equal_the_plain_rounds(spark, n, dims, spread):
    some = clustered(n, dims, n, spread).tolist()
    rows = [(i * 3, v, i % 4 if i % 5 else None) for i, v in enumerate(some)]
    rows += [(1, rows[0][1], 2), (1, rows[0][1], 2), (4, rows[2][1], None), (None, rows[1][1], 3)]
    rows += [(5, None, 1), (8, [NAN] * dims, 1), (11, [INF] * dims, 1), (14, [None] + [1.0] * (dims - 1), 1)]
    found, prints = code_rows(vectors(spark, [(*r, "x", "y", 1) for r in rows]).repartition(3))
    plain, fingerprint = plain_codes(rows)
    assert found == plain and prints == {fingerprint}


def test_vector_codes_edges(spark):
    assert vector_codes.vector_codes(vectors(spark, [])).collect() == []
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1, "", "", 1)])).collect() == []
    same = [(i, [0.5] * 8, None) for i in range(40)]
    found, _ = code_rows(vectors(spark, [(*r, "", "", 1) for r in same]))
    assert {(c, e) for _, c, e, _ in found} == {("00" * 8, 0)} and len(found) == 40
    with pytest.raises(ValueError, match="one length"):
        vector_codes.vector_codes(vectors(spark, [(1, [1.0] * 8, 1, "", "", 1), (2, [1.0] * 16, 1, "", "", 1)]))


def test_trees_own_balls_and_agree_with_plain_assignment():
    rng = np.random.default_rng(5)
    for spread, n in ((3, 900), (60, 500), (400, 333)):
        points = rng.integers(-4000, 4000, (20, 6))[rng.integers(0, 20, n)] + rng.integers(-spread, spread + 1, (n, 6))
        points[rng.integers(0, n, n // 3)] = points[0]
        tree = vector_codes.build(points)
        assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == points[tree.order]).all()
        assert tree.end[0] - tree.start[0] == n and (tree.sums[0] == points.sum(axis=0)).all()
        back = vector_codes.Tree.unpacked(tree.packed(), 6)
        book = points[rng.integers(0, n, 16)]
        book[5] = book[2]
        gap = ((points[:, None] - book) ** 2).sum(axis=2)
        entry, error = vector_codes.assigned(back, book)
        assert (entry == gap.argmin(axis=1)).all() and (error == gap.min(axis=1)).all()
        count, total = vector_codes.totals(back, book)
        assert (count == np.bincount(gap.argmin(axis=1), minlength=16)).all() and (total == [points[gap.argmin(axis=1) == k].sum(axis=0) for k in range(16)]).all()
        if spread == 3:
            assert vector_codes.ownership(tree, book)[2] < 0.35 * n * 16


def test_vector_codes_oracle_on_planted_rows(spark):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(clustered(60, 16, 3, 0.3).tolist())] + [(60, None, 1), (61, [NAN] * 16, 1)]
    table = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": [r[2] for r in rows]})
    con = duckdb.connect()
    con.register("embeddings", table)
    oracle = con.sql(vector_codes.oracle()).fetchall()
    found, prints = code_rows(vectors(spark, [(*r, "", "", 1) for r in rows]))
    assert sorted((r[:4] for r in oracle), key=str) == found and {r[4] for r in oracle} == prints


# ---- nearest neighbours ----


def plain_neighbours(rows, every=50, keep=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, q in sorted(good):
        if i % every == 0:
            scored = []
            for j, v in good:
                if j != i:
                    a, b = np.array(q, float), np.array(v, float)
                    scored.append((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), j))
            out |= {(i, k + 1, j, round(-s, 12)) for k, (s, j) in enumerate(sorted(scored)[:keep])}
    return out


def neighbour_rows(frame, **how):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in neighbours.nearest_of_every(frame, **how).collect()}


@pytest.fixture(scope="module")
def points():
    some = clustered(700, 12, 9, 0.4).tolist()
    rows = list(enumerate(some))
    rows += [(1000 + i, some[50]) for i in range(60)]  # copies of a query's vector, queries among them
    rows += [(2001, [2 * x for x in some[100]]), (2001, [2 * x for x in some[100]]), (2002, [-x for x in some[100]])]
    return rows + [(3000, None), (3050, [0.0] * 12), (3100, [NAN] * 12), (None, some[3]), (3150, [None] * 12)]


def test_neighbours_through_all_leaves_are_the_brute_force(spark, points):
    frame = vectors(spark, [(i, v, 1, "", "", 1) for i, v in points]).repartition(3)
    assert neighbour_rows(frame, budget=10**9, leaf=40) == plain_neighbours(points)


def test_neighbours_recall_with_a_fitted_budget(spark, points):
    frame = vectors(spark, [(i, v, 1, "", "", 1) for i, v in points])
    found, plain = neighbour_rows(frame, leaf=20), plain_neighbours(points)
    assert len(found) == len(plain)
    assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in plain}) >= 0.9 * len(plain)


def test_neighbours_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = neighbours.nearest_of_every(frame).collect()
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    plain = plain_neighbours(rows)
    assert len({(r.query_id, r.vec_id) for r in found} & {(q, v) for q, _, v, _ in plain}) >= 0.95 * len(plain)


def test_neighbours_groups_are_dealt_whole(spark, points, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    frame = vectors(spark, [(i, v, 1, "", "", 1) for i, v in points])
    assert neighbour_rows(frame, budget=10**9, leaf=200) == plain_neighbours(points)


def test_neighbours_edges(spark):
    assert neighbours.nearest_of_every(vectors(spark, [])).collect() == []
    assert neighbour_rows(vectors(spark, [(50, [1.0, 0.0], 1, "", "", 1)])) == set()
    three = [(0, [1.0, 0.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (50, [0.0, 1.0])]
    assert neighbour_rows(vectors(spark, [(i, v, 1, "", "", 1) for i, v in three])) == plain_neighbours(three)
    with pytest.raises(ValueError, match="lengths"):
        neighbours.nearest_of_every(vectors(spark, [(1, [1.0], 1, "", "", 1), (2, [1.0, 2.0], 1, "", "", 1)]))


# ---- conversations ----


def plain_repair(rows):
    """(cost, audit, repaired) by best-first search over (cost, audit), with nothing but the rules."""

    def state(roles):
        text = "".join(r[:1] or "?" for r in roles)
        body = text[1:] if text.startswith("s") else text
        return all(c == "ua"[i % 2] for i, c in enumerate(body)), bool(text == "" or (body and len(body) % 2 == 0))

    faults, seen = [], set()
    for role, text in rows:
        blank = not text.strip(" \t\n\v\f\r")
        faults.append("blank" if blank else "dup" if (role, text) in seen else "" if text.strip(" \t\n\v\f\r")[-1] in ".!?" else "cut")
        seen.add((role, text))
    queue = [(0, "", 0, ())]
    done = set()
    while queue:
        cost, audit, i, kept = heapq.heappop(queue)
        roles = tuple(r for r, _ in kept)
        if i == len(rows) and state(roles)[1]:
            return cost, audit, kept
        mark = i, tuple(r[:1] or "?" for r in roles)
        if mark in done:
            continue
        done.add(mark)
        moves = [(5, "I", i, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            moves.append((2, "D", i + 1, None))
            if faults[i] in ("", "cut"):
                more = 5 if faults[i] else 0
                moves += [(more, "K", i + 1, rows[i])] + [(1 + more, "R", i + 1, (r, rows[i][1])) for r in ("user", "assistant")]
        for more, letter, to, row in moves:
            after = (*kept, row) if row else kept
            if len(after) <= len(rows) + 2 and state([r for r, _ in after])[0]:
                heapq.heappush(queue, (cost + more, audit + letter, to, after))
    raise AssertionError


def plain_conversations(rows):
    """The whole contract, row by row."""
    out = {}
    groups = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = groups.setdefault(conv, [])
        if kind == 4:
            role = "user"
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in mine if t is not None}
        counts = {"blank": 0, "dup": 0, "cut": 0, "": 0}
        seen = set()
        for _, role, text in mine:
            bare = text.strip(" \t\n\v\f\r")
            counts["blank" if not bare else "dup" if (role, text) in seen else "" if bare[-1] in ".!?" else "cut"] += 1
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, kept = plain_repair([r[1:] for r in mine])
        lines = "\n".join(f"{r}:{t}" for r, t in kept)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["dup"], counts["cut"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"])
            text = rng.choice(["Yes.", "Why?", "no end", "", " \t\n", None, "Ja! ", "é.\v", "same.", "\x1c", "a "])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


def conversation_rows(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, copies string, kind int").repartition(5)
    return {r[0]: tuple(r[1:]) for r in conversation_repair.repair(conversation_repair.damaged(frame), **how).collect()}


def test_repair_equals_the_plain_search(spark, talks):
    plain = plain_conversations(talks)
    assert conversation_rows(spark, talks) == plain


@pytest.mark.parametrize("most", [0, 4])
def test_long_conversations_over_several_tasks(spark, talks, most):
    rng = random.Random(1)
    hot = [(77, t // 2, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two?", f"{t}!", "cut"])) for t in range(300)]
    assert conversation_rows(spark, talks + hot, most=most) == conversation_rows(spark, talks + hot, most=10**6)


def test_repair_oracle_on_planted_rows(spark, talks):
    con = duckdb.connect()
    columns = [list(c) for c in zip(*talks, strict=True)]
    con.register("conversations", pa.table({"conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()), "role": columns[2], "text": columns[3]}))
    assert {r[0]: r[1:] for r in con.sql(conversation_repair.ORACLE).fetchall()} == plain_conversations(talks)


def test_tables_of_pieces_equal_one_table():
    rng = random.Random(8)
    for _ in range(60):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 14)))
        cut = [rng.randint(0, len(codes)) for _ in range(2)]
        parts = [codes[: min(cut)], codes[min(cut) : max(cut)], codes[max(cut) :]]
        assert conversation_repair.folded([conversation_repair.table(p) for p in parts]) == conversation_repair.table(codes)


def test_inserts_where_they_are_cheap(monkeypatch):
    monkeypatch.setattr(conversation_repair, "INSERT", 1)
    conversation_repair.table.cache_clear()
    assert conversation_repair.cheapest(conversation_repair.table("ua")) == (0, "KK")
    assert conversation_repair.cheapest(conversation_repair.table("uua")) == (1, "KIKK")
    assert conversation_repair.cheapest(conversation_repair.table("s")) == (2, "D")
    conversation_repair.table.cache_clear()


def test_repair_of_an_empty_table(spark):
    assert conversation_rows(spark, []) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    none = hashlib.sha256(b"").hexdigest()
    assert conversation_rows(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", none)}


def test_damage_names_every_kind(spark):
    rows = [(c, 0, "assistant", "Ja! Nein? Gut.") for c in range(400)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for r in conversation_repair.damaged(frame).withColumn("key", F.concat_ws(":", "conv_id", "turn")).collect():
        kind = zlib.crc32(r.key.encode()) % 20
        expected = {0: ("assistant", "", 0), 1: ("assistant", "", 1), 2: ("assistant", "Ja Nein Gut", 1), 3: ("assistant", rows[0][3], 2), 4: ("user", rows[0][3], 1)}
        assert (r.role, r.text, r.copies) == expected.get(kind, ("assistant", rows[0][3], 1))
