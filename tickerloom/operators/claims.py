"""Claims of several workers on a day's stocks, settled from a log that workers only append to.

A log row is (trade_date, stock_code, worker, at, action): claim asks for the stock, beat prolongs the asker's lease, and
succeeded, failed and skipped_data_insufficient end it. Rows of a stock count in order of at, then worker, then action; so of
claims on a free stock the one of least (at, worker) wins, whoever wrote first. A claim is granted on a stock that
nobody has (insert), whose last run failed or was skipped (retry), or whose lease is over (take_over), and refused
otherwise. Beats and ends count only from the worker who has the stock, and ends also after the lease while nobody took
over; the others are ignored, so that a worker who was overtaken can't overwrite the result.

Rows may arrive late; a claim is settled once settle_s seconds have passed since it was made, within which its row and
every earlier one have to be in the log. Whoever holds a settled claim may work.

A stock's rows of a day are folded in one group: they are as many as its attempts and beats, whatever the market's size.
snapshot() turns rows into one state per stock, which later rows go on from, so that a log can be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.newstext import bound

LEASE_S, SETTLE_S = 600, 5
KEYS = ["trade_date", "stock_code"]
LOG_SCHEMA = "trade_date date, stock_code string, worker string, at bigint, action string"
STATE_SCHEMA = "trade_date date, stock_code string, owner string, status string, lease_end bigint, granted bigint, refused bigint, ignored bigint"
#: Rows whose verdicts are listed together before they are added to a stock's.
RUN_ROWS = 256
ENDS = ("succeeded", "failed", "skipped_data_insufficient")

_STATE = "struct<owner:string,status:string,lease_end:bigint,granted:bigint,refused:bigint,ignored:bigint>"
_VERDICT = "struct<worker:string,at:bigint,action:string,verdict:string>"


def _verdict(state: Column, row: Column) -> Column:
    """What a row is told in a state."""
    over = row["at"] >= state["lease_end"]
    mine = (state["status"] == "running") & (state["owner"] == row["worker"])
    claim = (
        F.when(state["status"].isNull(), "insert")
        .when(state["status"].isin("failed", "skipped_data_insufficient"), "retry")
        .when((state["status"] == "running") & over, "take_over")
        .when(state["status"] == "succeeded", "already_succeeded")
        .otherwise("running_by_other")
    )
    return F.when(row["action"] == "claim", claim).when(F.coalesce(mine & ((row["action"] != "beat") | ~over), F.lit(False)), row["action"]).otherwise("ignored")


def _after(state: Column, row: Column, verdict: Column, lease_s: int) -> Column:
    won = verdict.isin("insert", "retry", "take_over")
    one = lambda flag: F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return F.struct(
        F.when(won, row["worker"]).otherwise(state["owner"]).alias("owner"),
        F.when(won, "running").when(verdict.isin(*ENDS), verdict).otherwise(state["status"]).alias("status"),
        F.when(won | (verdict == "beat"), row["at"] + lease_s).otherwise(state["lease_end"]).alias("lease_end"),
        (state["granted"] + one(won)).alias("granted"),
        (state["refused"] + one(verdict.isin("already_succeeded", "running_by_other"))).alias("refused"),
        (state["ignored"] + one(verdict == "ignored")).alias("ignored"),
    ).cast(_STATE)


def _folded(log: DataFrame, lease_s: int, before: DataFrame | None, telling: bool) -> DataFrame:
    """KEYS with the state after all rows and, if telling, the list of their verdicts."""
    rows = log.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("at", "worker", "action"))).alias("rows"))
    nobody = F.expr(f"CAST(named_struct('owner', NULL, 'status', NULL, 'lease_end', NULL, 'granted', 0L, 'refused', 0L, 'ignored', 0L) AS {_STATE})")
    start = nobody
    if before is not None:
        held = before.select(*[F.col(k).alias(f"__{k}") for k in KEYS], F.struct(*[c for c in before.columns if c not in KEYS]).cast(_STATE).alias("held"))
        same = F.col("trade_date").eqNullSafe(F.col("__trade_date")) & F.col("stock_code").eqNullSafe(F.col("__stock_code"))
        rows = rows.join(held, same, "full_outer")
        rows = rows.select(*[F.coalesce(k, f"__{k}").alias(k) for k in KEYS], F.coalesce("rows", F.array().cast("array<struct<at:bigint,worker:string,action:string>>")).alias("rows"), "held")
        start = F.coalesce(F.col("held"), nobody)
    none = F.array().cast(f"array<{_VERDICT}>")

    def step(acc: Column, row: Column) -> Column:
        def after(verdict: Column) -> Column:
            told = F.struct(row["worker"].alias("worker"), row["at"].alias("at"), row["action"].alias("action"), verdict.alias("verdict")).cast(_VERDICT)
            return F.struct(_after(acc["state"], row, verdict, lease_s).alias("state"), (F.concat(acc["told"], F.array(told)) if telling else acc["told"]).alias("told"))

        return bound(_verdict(acc["state"], row), after)

    if not telling:
        return rows.select(*KEYS, F.aggregate("rows", F.struct(start.alias("state"), none.alias("told")), step).alias("end"))

    # Adding to a list copies it, so verdicts are listed per run of rows, and the runs' lists in a list.
    def run(acc: Column, place: Column) -> Column:
        of_run = F.slice("rows", place * RUN_ROWS + 1, F.lit(RUN_ROWS))
        end = F.aggregate(of_run, F.struct(acc["state"].alias("state"), none.alias("told")), step)
        return bound(end, lambda e: F.struct(e["state"].alias("state"), F.concat(acc["told"], F.array(e["told"])).alias("told")))

    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("rows") - 1) / RUN_ROWS).cast("int")))
    lists = F.aggregate(places, F.struct(start.alias("state"), F.array().cast(f"array<array<{_VERDICT}>>").alias("told")), run)
    return rows.select(*KEYS, lists.alias("end")).select(*KEYS, F.struct("end.state", F.flatten("end.told").alias("told")).alias("end"))


def snapshot(log: DataFrame, lease_s: int = LEASE_S, before: DataFrame | None = None) -> DataFrame:
    """STATE_SCHEMA, a row per stock: who has it, its status, and how many claims were granted, refused or ignored.

    before: a snapshot of all rows older than log's; stocks without newer rows stay as they are there.
    """
    return _folded(log, lease_s, before, telling=False).select(*KEYS, "end.state.*")


def verdicts(log: DataFrame, lease_s: int = LEASE_S, before: DataFrame | None = None) -> DataFrame:
    """Every row of log with what became of it."""
    return _folded(log, lease_s, before, telling=True).select(*KEYS, F.explode("end.told").alias("one")).select(*KEYS, "one.*")


def append(log_path: str, rows: DataFrame) -> None:
    """Adds rows to a log; a worker's rows appear together."""
    rows.coalesce(1).write.mode("append").parquet(log_path)


def owned(log: DataFrame, worker: str, now: int, lease_s: int = LEASE_S, settle_s: int = SETTLE_S) -> DataFrame:
    """The stocks that worker may work on at now: it has them, its lease runs, and nobody's claim can still precede its own."""
    # A claim that is not settled yet must not count for its maker, but counts against others.
    mine = snapshot(log.where(F.col("at") <= now), lease_s)
    mine = mine.where((F.col("owner") == worker) & (F.col("status") == "running") & (F.col("lease_end") > now))
    settled = verdicts(log.where(F.col("at") <= now), lease_s).where((F.col("worker") == worker) & F.col("verdict").isin("insert", "retry", "take_over"))
    since = settled.groupBy(*KEYS).agg(F.max("at").alias("since")).where(F.col("since") <= now - settle_s)
    return mine.join(since.select(*KEYS), KEYS, "left_semi").select(*KEYS, "lease_end")
