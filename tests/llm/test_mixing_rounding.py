"""The pivotal steps of mixing against plain Python, and what they promise over many draws."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickerloom.llm import mixing


def draw(*values):
    """Spark's xxhash64 of longs (and a last int) as a number in [0, 1)."""
    h = 42
    for v in values[:-1]:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed=h)
    h = xxhash.xxh64_intdigest(int(values[-1]).to_bytes(4, "little", signed=True), seed=h)
    return (h >> 11) / (1 << 53)


def plain_fold(items):
    """(carry, done) of items {size, mark, p}: the largest first, equal sizes by mark; mass moves until one is whole."""
    carry, done = None, []
    for x in sorted(items, key=lambda i: (-i["size"], i["mark"])):
        x = dict(x)
        if carry is None:
            carry = x
            continue
        c = carry
        up = min((1 - c["p"]) * c["size"], x["p"] * x["size"])
        down = min(c["p"] * c["size"], (1 - x["p"]) * x["size"])
        if draw(c["mark"], x["mark"], mixing.SEED) * (up + down) < down:
            c_whole, x_whole = up == (1 - c["p"]) * c["size"], up == x["p"] * x["size"]
            c["p"], x["p"] = (1.0 if c_whole else c["p"] + up / c["size"]), (0.0 if x_whole else x["p"] - up / x["size"])
        else:
            c_whole, x_whole = down == c["p"] * c["size"], down == (1 - x["p"]) * x["size"]
            c["p"], x["p"] = (0.0 if c_whole else c["p"] - down / c["size"]), (1.0 if x_whole else x["p"] + down / x["size"])
        done += [i for i, whole in ((c, c_whole), (x, x_whole)) if whole]
        carry = c if not c_whole else x if not x_whole else None
    return carry, done


def groups(rng, n):
    out = []
    for g in range(n):
        size = rng.integers(1, 400, rng.integers(1, 9))
        out += [{"g": g, "doc_id": int(rng.integers(1, 1 << 40)), "nth": 1, "size": int(s), "mark": int(rng.integers(-(1 << 62), 1 << 62)), "p": float(rng.choice([0.25, 0.5, rng.random()]))} for s in size]
    return out


def folded(spark, rows):
    table = spark.createDataFrame([(r["g"], -r["size"], r["mark"], r["doc_id"], r["nth"], r["size"], r["p"]) for r in rows], "g int, neg_size bigint, mark bigint, doc_id bigint, nth bigint, size bigint, p double")
    level = table.select("g", F.struct("neg_size", "mark", "doc_id", "nth", "size", "p").alias("item"))
    return {r.g: r for r in mixing._folded(level, ["g"]).collect()}


def test_folds_equal_the_plain_steps(spark):
    rows = groups(np.random.default_rng(3), 200)
    found = folded(spark, rows)
    for g in range(200):
        mine = [r for r in rows if r["g"] == g]
        carry, done = plain_fold(mine)
        got = found[g]
        assert (got.carry and (got.carry.doc_id, pytest.approx(got.carry.p))) == (carry and (carry["doc_id"], carry["p"]))
        assert sorted((i.doc_id, i.p) for i in got.done) == sorted((i["doc_id"], i["p"]) for i in done)
        # Each step settles one at least, and no word is won or lost.
        assert all(i.p in (0.0, 1.0) for i in got.done) and len(got.done) + (got.carry is not None) == len(mine)
        assert sum(i.p * i.size for i in [*got.done, *([got.carry] if got.carry else [])]) == pytest.approx(sum(r["p"] * r["size"] for r in mine))


def test_expectations_over_many_draws(spark):
    """Over 4,000 draws of the same eight documents each one's mean is its p."""
    rng = np.random.default_rng(4)
    base = [(i, int(s), p) for i, (s, p) in enumerate(zip([300, 210, 90, 60, 60, 41, 7, 3], [0.3, 0.8, 0.5, 0.25, 0.6, 0.1, 0.9, 0.45], strict=True))]
    rows = [{"g": g, "doc_id": i, "nth": 1, "size": s, "mark": int(rng.integers(-(1 << 62), 1 << 62)), "p": p} for g in range(4000) for i, s, p in base]
    total = np.zeros(8)
    for r in folded(spark, rows).values():
        for item in [*r.done, *([r.carry] if r.carry else [])]:
            total[item.doc_id] += item.p
    want = np.array([p for _, _, p in base])
    assert np.abs(total / 4000 - want).max() < 4 * np.sqrt((want * (1 - want)).max() / 4000)


def test_copies_meet_targets_over_seeds(spark, monkeypatch):
    """Over seeds: every document takes base or base + 1 copies of its expectation, and means follow the expectations."""
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 23), "a" if i % 3 else "b") for i in range(90)], "doc_id bigint, text string, source string")
    taken: dict[int, list[int]] = {}
    share = {}
    for seed in range(12):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.copies(docs).collect():
            taken.setdefault(r.doc_id, []).append(r.copies)
            share[r.doc_id] = r.target / r.source_size
    assert all(set(c) <= {int(share[i]), int(share[i]) + 1} for i, c in taken.items())
    off = [np.mean(c) - share[i] for i, c in taken.items()]
    assert abs(np.mean(off)) < 0.05 and np.abs(off).max() < 0.6
