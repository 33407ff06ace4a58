"""Claims settled from logs that several workers wrote in any order, against a replay in plain Python."""

import random

from pyspark.sql import functions as F

from tickerloom.operators import claims


def frame(spark, rows):
    return spark.createDataFrame([("2024-01-02", *r) for r in rows], claims.LOG_SCHEMA.replace("trade_date date", "trade_date string")).selectExpr("to_date(trade_date) AS trade_date", "stock_code", "worker", "at", "action")


def replay(rows, lease):
    """stock -> (owner, status, lease_end), and the verdict of every row."""
    state, told = {}, []
    for stock, worker, at, action in sorted(rows, key=lambda r: (r[0], r[2], r[1], r[3])):
        owner, status, end = state.get(stock, (None, None, None))
        if action == "claim":
            if status is None:
                verdict = "insert"
            elif status in ("failed", "skipped_data_insufficient"):
                verdict = "retry"
            elif status == "succeeded":
                verdict = "already_succeeded"
            else:
                verdict = "take_over" if at >= end else "running_by_other"
            if verdict in ("insert", "retry", "take_over"):
                state[stock] = worker, "running", at + lease
        elif status == "running" and owner == worker and (action != "beat" or at < end):
            verdict = action
            state[stock] = (owner, "running", at + lease) if action == "beat" else (owner, action, end)
        else:
            verdict = "ignored"
        told.append((stock, worker, at, action, verdict))
    return state, sorted(told)


def test_interleaved_workers_leave_one_owner(spark):
    rng = random.Random(6)
    actions = ["claim"] * 6 + ["beat"] * 3 + ["failed", "skipped_data_insufficient", "succeeded"]
    rows = list({(f"s{rng.randrange(12)}", f"w{rng.randrange(4)}", rng.randrange(3000), rng.choice(actions)) for _ in range(600)})
    rng.shuffle(rows)
    log = frame(spark, rows).repartition(7)
    state, told = replay(rows, 200)
    assert {r.stock_code: (r.owner, r.status, r.lease_end) for r in claims.snapshot(log, 200).collect()} == state
    assert sorted((r.stock_code, r.worker, r["at"], r.action, r.verdict) for r in claims.verdicts(log, 200).collect()) == told
    for now in (150, 900, 2999):
        held = replay([r for r in rows if r[2] <= now], 200)[0]
        want = {s for s, (_, status, end) in held.items() if status == "running" and end > now}
        each = [{r.stock_code for r in claims.owned(log, f"w{i}", now, 200, settle_s=0).collect()} for i in range(4)]
        assert set().union(*each) == want and sum(map(len, each)) == len(want)


def test_snapshots_go_on_where_they_ended(spark):
    rng = random.Random(7)
    rows = list({(f"s{rng.randrange(9)}", f"w{rng.randrange(3)}", rng.randrange(2000), rng.choice(["claim", "claim", "beat", "failed"])) for _ in range(200)})
    log = frame(spark, rows)
    first = claims.snapshot(log.where("at < 1000 AND stock_code <> 's3'"), 100)
    went_on = claims.snapshot(log.where("at >= 1000 AND stock_code <> 's4'"), 100, before=first)
    whole = claims.snapshot(log.where("(at < 1000 AND stock_code <> 's3') OR (at >= 1000 AND stock_code <> 's4')"), 100)
    assert {tuple(r) for r in went_on.collect()} == {tuple(r) for r in whole.collect()}


def test_a_late_row_of_an_earlier_claim_wins_before_it_is_settled(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    claims.append(path, frame(spark, [("s", "w2", 100, "claim"), ("t", "w2", 100, "claim")]))
    read = lambda: spark.read.schema(claims.LOG_SCHEMA).parquet(path)
    owned = lambda worker, now: [r.stock_code for r in claims.owned(read(), worker, now, 60, settle_s=5).orderBy("stock_code").collect()]
    assert owned("w2", 103) == []
    claims.append(path, frame(spark, [("s", "w1", 99, "claim"), ("t", "w3", 100, "claim")]))
    assert owned("w2", 105) == ["t"] and owned("w1", 105) == ["s"] and owned("w3", 105) == []
    assert owned("w1", 159) == []
    claims.append(path, frame(spark, [("s", "w2", 159, "claim"), ("s", "w1", 160, "succeeded")]))
    assert owned("w2", 164) == ["s"]
    verdict = {(r.worker, r["at"]): r.verdict for r in claims.verdicts(read(), 60).where("stock_code = 's'").collect()}
    assert verdict == {("w1", 99): "insert", ("w2", 100): "running_by_other", ("w2", 159): "take_over", ("w1", 160): "ignored"}


def test_no_claims(spark):
    assert claims.snapshot(frame(spark, [("s", "w", 1, "claim")]).limit(0)).collect() == []


def test_verdicts_listed_by_runs(spark, monkeypatch):
    rows = [(str(i % 2), f"w{i * 7 % 3}", 1000 + i * 3, ("claim", "beat", "claim", "failed", "claim", "beat", "succeeded" if i > 180 else "claim")[i % 7]) for i in range(200)]
    log = spark.createDataFrame(rows, "stock_code string, worker string, at bigint, action string").select(F.lit("2024-01-05").cast("date").alias("trade_date"), "*")
    found = []
    for size in (256, 7, 100):
        monkeypatch.setattr(claims, "RUN_ROWS", size)
        found.append(sorted(tuple(r) for r in claims.verdicts(log, 20).collect()))
    assert len(found[0]) == 200 and found[0] == found[1] == found[2]
