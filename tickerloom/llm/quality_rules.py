"""Quality rules kept as a ledger of bitmasks.

ledger() evaluates every rule once per text and stores the measurements and fail_bits, in which bit i says that rule i
of RULES failed. A policy is a version's mask of the rules in force: it is applied by one bitwise AND, without the
text. ablations() counts, per rule, the documents that fail it, that fail only it, and that pass once it is dropped,
from a table with one row per bit pattern that occurs.

Words are runs of bytes other than ASCII white space, lines are split at \\n, both over the whole text. Null text has
no words and fails few_words. Repeated rows are measured once each. An empty table gives an empty ledger. Columns of
docs other than doc_id and text are not read; filtering keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")

#: Rule names and their failing conditions over MEASURES, in order of bits; Spark SQL and DuckDB read them alike.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbol_noise": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "10 * n_shouts > 6 * n_words",
}


def mask(*names: str) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


#: Versions of the policy: the rules in force.
POLICIES = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask("few_words", "repeated_words", "symbol_noise", "repeated_lines"),
    "v2": mask(*RULES),
}
CURRENT = "v2"

_SPACES = np.array([b in b" \t\n\v\f\r" for b in range(256)])
_CONTINUES = np.array([b & 0xC0 == 0x80 for b in range(256)])
_SYMBOLS = np.array([b in b"#*$%&|<>" for b in range(256)])


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of width words found twice or more in the list."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=n)
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)
    if len(seen) ** width < 1 << 64:  # a window's number in base len(seen) is exact
        keys = windows @ (np.uint64(len(seen)) ** np.arange(width, dtype=np.uint64))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
    else:
        order = np.lexsort(windows.T)
        same = (windows[order][1:] == windows[order][:-1]).all(axis=1)
    if not same.any():
        return 0
    hit = np.zeros(n + 1, dtype=np.int64)
    starts = np.union1d(order[1:][same], order[:-1][same])
    hit[starts] += 1
    hit[starts + width] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """MEASURES of one UTF-8 text."""
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return (
        len(words),
        int(len(raw) - counts[_SPACES].sum() - counts[_CONTINUES].sum()),
        int(counts[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(counts[33]),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t.as_py() or b"") for t in batch.column(1)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], ["doc_id", *MEASURES])

    columns = ", ".join(f"{m} bigint" for m in MEASURES)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, f"doc_id bigint, {columns}")


def fail_bits() -> Column:
    bits = [F.when(F.expr(failing), F.lit(1 << i)).otherwise(F.lit(0)) for i, failing in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("bigint")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and fail_bits of every row."""
    return measured(docs).withColumn("fail_bits", fail_bits())


def passes(policy: str = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(kept_ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rule, n_failed, n_failed_alone, n_kept, n_kept_without."""
    force = F.lit(POLICIES[policy])
    patterns = kept_ledger.groupBy(F.col("fail_bits").bitwiseAND(force).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    of_policy = [(name, 1 << i) for i, name in enumerate(RULES) if POLICIES[policy] >> i & 1]
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for n, b in of_policy])).alias("r")
    crossed = patterns.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    return crossed.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
s AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM p),
twice AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, range(0, {WINDOW}) AS k(o) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(RULES.values()))})::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & {POLICIES["base"]} <> 0 AS base_failed, fail_bits & {POLICIES[CURRENT]} = 0 AS kept FROM b
"""


def _ablations_oracle(policy: str = CURRENT) -> str:
    """The ablations from the failing conditions themselves, rule by rule, without the bits."""
    force = [(name, failing) for i, (name, failing) in enumerate(RULES.items()) if POLICIES[policy] >> i & 1]
    others = {name: " OR ".join(f"({c})" for n, c in force if n != name) for name, _ in force}
    every = " OR ".join(f"({c})" for _, c in force)
    rows = [
        f"SELECT '{name}' AS rule, count(*) FILTER ({c}) AS n_failed, count(*) FILTER (({c}) AND NOT ({others[name]})) AS n_failed_alone, count(*) FILTER (NOT ({every})) AS n_kept, count(*) FILTER (NOT ({others[name]})) AS n_kept_without FROM b"
        for name, c in force
    ]
    return ORACLE.rpartition("SELECT *, fail_bits &")[0] + " UNION ALL ".join(rows)


ABLATIONS_ORACLE = _ablations_oracle()
