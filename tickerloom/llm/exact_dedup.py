"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every text is digested once, into a narrow table. Each input partition then forms a run: its rows sorted by digest, equal
neighbours folded into one row with the identifier that stays and the rows counted. The runs are cut at the same digests
into CELLS ranges, and one exchange brings a range of all runs together; the binomial rounds then need no further one:
in each, 2**FAN_BITS neighbouring runs become one, the task merging its sorted pieces of them and advancing through the
merged run once, folding equal neighbours again. So identifiers that lose never travel further, a round holds one row in
memory, and a text that holds a third of all rows costs one row per run. The state that a fold carries is a struct,
which Spark folds in sort order (SortAggregate over Sort) and not in a hash table; a test holds the plan to that, and
to the two exchanges.

A digest is verified at every level: SHA-256, byte length and a second, independent 64-bit hash must all agree. The texts
themselves are not compared: two that agree in all three would be a collision of SHA-256.

Null text counts as empty text; empty texts are equal to one another. A null doc_id loses against any other. Rows that
repeat a doc_id and its text are one document: each counts in group_size and all share the verdict. An empty table
gives an empty result. Columns other than doc_id and text are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import fresh, lower_ascii, written

#: Runs at the leaves of the tree, and how many bits of the run number each round folds away.
RUN_BITS = 6
FAN_BITS = 3
#: Ranges of digests that runs are cut into; a task holds one or several of them.
CELLS = 1 << 12

KEY = ["digest", "octets", "second"]


def digest_columns(text: Column) -> list[Column]:
    body = lower_ascii(F.coalesce(text, F.lit("")))
    return [
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
        F.octet_length(body).cast("long").alias("octets"),
        F.xxhash64(body).alias("second"),
    ]


def _folded(runs: DataFrame) -> DataFrame:
    """Equal neighbours of sorted runs as one row; best is a struct, so the fold follows the sort order."""
    return runs.groupBy("run", "cell", *KEY).agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))


def merged_runs(rows: DataFrame, keep: str = "max", run_bits: int = RUN_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Of rows (doc_id and KEY), one row per text: KEY, keep_id, group_size. keep: "max" or "min" identifier."""
    place = F.col("doc_id") if keep == "max" else F.bitwise_not(F.col("doc_id"))
    # Any identifier is better than none.
    best = F.struct(F.col("doc_id").isNotNull().alias("there"), place.alias("place"), "doc_id")
    run = F.pmod(F.spark_partition_id(), F.lit(1 << run_bits))
    cell = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int") % CELLS
    runs = _folded(rows.select(run.alias("run"), cell.alias("cell"), *KEY, best.alias("best"), F.lit(1).cast("long").alias("group_size")))
    # From here on a task has a range of digests of all runs.
    runs = runs.repartition("cell")
    left = run_bits
    while left > 0:
        step = min(fan_bits, left)
        left -= step
        runs = _folded(runs.withColumn("run", F.shiftright("run", step)))
    return runs.select(*KEY, F.col("best.doc_id").alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(docs.select("doc_id", *digest_columns(F.col("text"))), "exact-digests")
    groups = merged_runs(rows, keep)
    return rows.join(groups, KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def raw_columns(text: Column) -> list[Column]:
    """What tells rows of one doc_id apart: their texts as they are, by length and two hashes that cost next to nothing."""
    own = F.coalesce(text, F.lit(""))
    return [F.xxhash64(own).alias("raw"), F.hash(own).alias("raw_second"), F.octet_length(own).alias("raw_octets")]


def exact_distinct(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with docs' own columns.

    Texts are digested into a narrow table; docs then meets the rows of it that stay by doc_id and raw_columns, which are
    read off the texts again. They need only tell apart the texts of rows that share a doc_id.
    """
    narrow = written(docs.select("doc_id", *digest_columns(F.col("text")), *raw_columns(F.col("text"))), "exact-digests")
    groups = merged_runs(narrow, keep)
    same = [narrow[k] == groups[k] for k in KEY] + [narrow["doc_id"].eqNullSafe(groups["keep_id"])]
    raws = ["raw", "raw_second", "raw_octets"]
    stay = narrow.join(groups, same, "left_semi").select(F.col("doc_id").alias("stays"), *[F.col(r).alias(f"stays_{r}") for r in raws])
    names = [fresh(docs, r) for r in raws]
    tagged = docs.select("*", *[c.alias(n) for n, c in zip(names, raw_columns(F.col("text")), strict=True)])
    on = [tagged["doc_id"].eqNullSafe(stay["stays"])] + [tagged[n] == stay[f"stays_{r}"] for n, r in zip(names, raws, strict=True)]
    return tagged.join(stay, on, "left_semi").select(*docs.columns)
