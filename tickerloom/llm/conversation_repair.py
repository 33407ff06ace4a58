r"""Repair of conversations whose rows are missing, blank, repeated, cut off or out of turn, by the cheapest edits.

A conversation's rows are taken by turn (nulls first), then role, then text. A row's first fault counts: blank (no character but
ASCII white space), duplicate (role and text seen earlier), truncated (the last such character is none of .!?). Edits: Keep
costs 0, Rerole to user or assistant 1, Delete 2 (the only edit of blank and duplicate rows), Insert of a user or
assistant with empty text 5; a truncated row that stays adds 5. The role initials have to read (s?(ua)+)? afterwards.
Among the cheapest edits the one whose initials are ASCII-least is taken; it settles the repaired rows too, as the role
of a Rerole or Insert follows from its place.

Weights. An edit is one integer: its cost in the high digits, and below them one digit per place of the audit, so that
an edit at place k adds its letter (D < I < K < R) at digit k and the digits after the last edit stay zero. A node of
the graph is (rows taken, rows inserted, state of the pattern); the place is the sum of the first two. Then the least
integer over all paths is the cheapest and ASCII-least audit at once, and an ordinary shortest-path table of integers
finds it. A first table without digits bounds the inserts, and so the width.

Long conversations. The same table, from every state to every state, makes PIECE rows a transition; transitions of neighbouring
pieces combine by the least sum, as equal costs never have one audit that begins the other. Conversations of at most
MOST rows are repaired in one go. Longer ones are dealt by ranges of their rows, duplicates come from an aggregate by
text, tasks fold their pieces, and a conversation's folds (one per task) meet. Only its SHA-256, which has no parts, is
then streamed through one task, a batch of rows at a time; audit and folds take some bytes a row.

Null roles and texts are one space, as is a null conv_id or turn in the damage's key. An empty role has no initial, so
it can't be kept. A null conv_id is a conversation.
Rows with equal turn, role and text are interchangeable. Conversations without rows have cost 0, an empty audit and the
hash of an empty text; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import small_side, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE = 24
MOST = 512

LETTERS = " DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES = range(4)
ENDS = (0, 3)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {"u": "user", "a": "assistant"}
ALTERNATIONS = ("su", "ua", "au")

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

Transition = dict[tuple[int, int], tuple[int, str]]


def edits(code: str, state: int) -> list[tuple[int, int, int]]:
    """(cost, letter, next state) of what may be done with a row: code is s, u, a or x for other roles, in capitals if
    truncated, and d if the row has to go."""
    out = [(DELETE, _D, state)]
    if code == "d":
        return out
    more = TRUNCATED if code.isupper() else 0
    role = code.lower()
    if state in STEPS.get(role, {}):
        out.append((KEEP + more, _K, STEPS[role][state]))
    return out + [(REROLE + more, _R, STEPS[r][state]) for r in ROLE if state in STEPS[r]]


def inserts(state: int) -> list[int]:
    return [STEPS[r][state] for r in ROLE if state in STEPS[r]]


def _costs(codes: str, start: int) -> dict[int, int]:
    """The least cost from start to every state that can be reached."""

    def with_inserts(at: dict[int, int]) -> dict[int, int]:
        for _ in STATES:
            for q, c in list(at.items()):
                for to in inserts(q):
                    at[to] = min(at.get(to, c + INSERT), c + INSERT)
        return at

    at = with_inserts({start: 0})
    for code in codes:
        after: dict[int, int] = {}
        for q, c in at.items():
            for cost, _, to in edits(code, q):
                after[to] = min(after.get(to, c + cost), c + cost)
        at = with_inserts(after)
    return at


@lru_cache(maxsize=1 << 16)
def table(codes: str) -> Transition:
    """The cheapest, then ASCII-least edits from every state to every state: {(from, to): (cost, audit)}."""
    out: Transition = {}
    for start in STATES:
        most = max(_costs(codes, start).values()) // INSERT
        length = len(codes) + most
        width = 3 * length
        at = {(0, start): 0}

        def put(cells: dict[tuple[int, int], int], key: tuple[int, int], weight: int) -> None:
            if weight < cells.get(key, weight + 1):
                cells[key] = weight

        for i in range(len(codes) + 1):
            for added in range(most):
                for q in STATES:
                    if (added, q) in at:
                        weight = at[added, q] + (INSERT << width) + (_I << 3 * (length - 1 - i - added))
                        for to in inserts(q):
                            put(at, (added + 1, to), weight)
            if i == len(codes):
                break
            after: dict[tuple[int, int], int] = {}
            for (added, q), weight in at.items():
                place = 3 * (length - 1 - i - added)
                for cost, letter, to in edits(codes[i], q):
                    put(after, (added, to), weight + (cost << width) + (letter << place))
            at = after
        for end in STATES:
            found = [w for (_, q), w in at.items() if q == end]
            if found:
                least = min(found)
                digits = (least >> 3 * k & 7 for k in range(length - 1, -1, -1))
                out[start, end] = least >> width, "".join(LETTERS[d] for d in digits if d)
    return out


def combined(a: Transition, b: Transition) -> Transition:
    out: Transition = {}
    for (start, middle), (cost, audit) in a.items():
        for end in STATES:
            if (middle, end) in b:
                more, rest = b[middle, end]
                new = cost + more, audit + rest
                if (start, end) not in out or new < out[start, end]:
                    out[start, end] = new
    return out


def folded(parts: list[Transition]) -> Transition:
    """Neighbours combined in pairs, so that audits are copied a few times only."""
    while len(parts) > 1:
        parts = [combined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else table("")


def transition(codes: str) -> Transition:
    return folded([table(codes[i : i + PIECE]) for i in range(0, len(codes), PIECE)])


def cheapest(whole: Transition) -> tuple[int, str]:
    return min(whole[0, end] for end in ENDS if (0, end) in whole)


def fault(text: str, seen: bool) -> str:
    if not _WORD.search(text):
        return "blank"
    if seen:
        return "duplicate"
    return "" if text.rstrip(_BLANKS)[-1] in ".!?" else "truncated"


def code_of(role: str, found: str) -> str:
    if found in ("blank", "duplicate"):
        return "d"
    code = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return code.upper() if found else code


class Repair:
    """Follows an audit over a conversation's rows and hashes the repaired lines as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.lines = audit, 0, 0, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1
        self.state = STEPS[role[0]][self.state]

    def _wanted(self) -> str:
        return ROLE["a" if self.state == 2 else "u"]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(self._wanted(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._line(role if letter == "K" else self._wanted(), text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SCHEMA = "conv_id {}, " + ", ".join(f"{f} bigint" for f in FIELDS) + ", audit string, repaired_sha256 string"


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """FIELDS, audit and repaired_sha256 of a conversation's (turn, role, text) in order."""
    counts = {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}
    seen, codes = set(), []
    for _, role, text in rows:
        found = fault(text, (role, text) in seen)
        seen.add((role, text))
        counts[found] += 1
        codes.append(code_of(role, found))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ALTERNATIONS for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = cheapest(transition("".join(codes)))
    work = Repair(audit)
    for _, role, text in rows:
        work.row(role, text)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, work.digest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) with how often each is there after the damage: 0, 1 or 2.

    Rows that are dropped stay, without text, so that their conversation does.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    return rows.selectExpr(
        "conv_id",
        "turn",
        "IF(kind = 4, 'user', role) AS role",
        "CASE WHEN kind IN (0, 1) THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text",
        "CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS copies",
    )


def _batch(out: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_RESULT_NAMES = ["conv_id", *FIELDS, "audit", "repaired_sha256"]


def _result_kinds(key: pa.DataType) -> list[pa.DataType]:
    return [key, *[pa.int64()] * len(FIELDS), pa.string(), pa.string()]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: repairs one after the other."""
    key, rows, out, kinds, some = None, [], [], None, False
    for batch in batches:
        kinds = kinds or _result_kinds(batch.schema.field(0).type)
        for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if some and conv != key:
                out.append((key, *repaired(rows)))
                rows = []
            key, some = conv, True
            rows += [(turn, role, text)] * copies
        if len(out) >= 1000:
            yield _batch(out, kinds, _RESULT_NAMES)
            out = []
    if some:
        out.append((key, *repaired(rows)))
        yield _batch(out, kinds, _RESULT_NAMES)


_PART_NAMES = ["conv_id", "task", "blank", "duplicate", "truncated", "illegal", "head", "tail", "ends", "costs", "audits"]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text, seen) in order: a row per conversation of the task, with its rows' folded transitions."""
    task = TaskContext.get().partitionId()
    key, kinds, some, out = None, None, False, []
    counts: dict[str, int] = {}
    illegal, head, tail, codes, parts = 0, "", "", [], []

    def done() -> tuple:
        whole = folded([*parts, table("".join(codes))])
        pairs = [[a * 4 + b, c, t] for (a, b), (c, t) in whole.items()]
        found = [counts.get(f, 0) for f in ("blank", "duplicate", "truncated")]
        return (key, task, *found, illegal, head, tail, *([p[i] for p in pairs] for i in range(3)))

    for batch in batches:
        kinds = kinds or [batch.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
        for conv, role, text, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if some and conv != key:
                out.append(done())
                counts, illegal, some, codes, parts = {}, 0, False, [], []
            if some:
                illegal += tail + role[:1] not in ALTERNATIONS
            else:
                head = role[:1]
            key, some, tail = conv, True, role[:1]
            found = fault(text, seen)
            counts[found] = counts.get(found, 0) + 1
            codes.append(code_of(role, found))
            if len(codes) == PIECE:
                parts, codes = [*parts, table("".join(codes))], []
    if some:
        out.append(done())
    if kinds:
        yield _batch(out, kinds, _PART_NAMES)


def _met(key, frame):
    """One row of a long conversation from its tasks' rows."""
    import pandas as pd

    frame = frame.sort_values("task")
    parts = [{divmod(int(e), 4): (int(c), a) for e, c, a in zip(*row, strict=True)} for row in zip(frame["ends"], frame["costs"], frame["audits"], strict=True)]
    cost, audit = cheapest(folded(parts))
    between = sum(a + b not in ALTERNATIONS for a, b in zip(frame["tail"], frame["head"].iloc[1:], strict=False))
    sums = [int(frame[f].sum()) for f in ("blank", "duplicate", "truncated")]
    return pd.DataFrame([[key[0], *sums, int(frame["illegal"].sum()) + between, cost, audit]], columns=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's result row with its audit, then its rows in order: the result with the hash."""
    held, work, out, kinds = None, None, [], None
    for batch in batches:
        kinds = kinds or _result_kinds(batch.schema.field(0).type)
        for conv, audit, role, text, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                if held:
                    out.append((*held, work.digest()))
                held, work = (conv, *numbers, audit), Repair(audit)
            else:
                work.row(role, text)
    if held:
        out.append((*held, work.digest()))
    if kinds:
        yield _batch(out, kinds, _RESULT_NAMES)


def _repaired_long(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of long conversations, each of them spread over tasks."""
    one = rows.withColumn("copy", F.explode(F.expr("IF(copies = 0, array(), sequence(1, copies))")))
    one = written(one.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row")), "long")
    order = ["turn", "role", "text", "row"]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = one.withColumn("digest", digest)
    earliest = marked.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("text_of")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "row")).alias("first"))
    known = marked.join(earliest, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_of")))
    known = known.withColumn("seen", F.col("row") != F.col("first.row")).select("conv_id", *order, "seen")
    tasks = known.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", "role", "text", "seen")
    key = one.schema["conv_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in _PART_NAMES[1:6])
    parts = written(tasks.mapInArrow(_parts, f"conv_id {key}, {numbers}, head string, tail string, ends array<int>, costs array<bigint>, audits array<string>"), "parts")
    met = parts.groupBy("conv_id").applyInPandas(_met, f"conv_id {key}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")
    turns = one.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("of"))
    turns = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    met = written(met.join(turns, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of"), "met")
    first = met.select("conv_id", "audit", F.lit("").alias("role"), F.lit("").alias("text"), *FIELDS, F.lit(0).alias("after"), F.lit(None).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("row"))
    nothing = [F.lit(0).cast("bigint").alias(f) for f in FIELDS]
    then = one.select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", *nothing, F.lit(1).alias("after"), "turn", "row")
    stream = first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "after", *order)
    return stream.select("conv_id", "audit", "role", "text", *FIELDS).mapInArrow(_hashed, schema)


def repair(rows: DataFrame, most: int = MOST) -> DataFrame:
    """conv_id, FIELDS, audit and repaired_sha256 of every conversation of rows (conv_id, turn, role, text, copies).

    Conversations of more than most rows are spread over tasks; the result is the same.
    """
    schema = _SCHEMA.format(rows.schema["conv_id"].dataType.simpleString())
    long_ = rows.groupBy(F.col("conv_id").alias("of")).agg(F.sum("copies").alias("n")).where(F.col("n") > most).select("of")
    short = rows
    if not long_.isEmpty():
        long_ = small_side(written(long_, "long-ids"))
        same = F.col("conv_id").eqNullSafe(F.col("of"))
        short = rows.join(long_, same, "left_anti")
    one_go = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_whole, schema)
    return one_go if short is rows else one_go.unionByName(_repaired_long(rows.join(long_, same, "left_semi"), schema))


ORACLE = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce([n]::UBIGINT[] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
    lambda c, _: CASE WHEN (c & 1) = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce([4294967295]::UBIGINT[] || list_transform(string_split(key, ''), lambda x: ascii(x)::UBIGINT),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair FROM o),
step(q, c, nq) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins AS (SELECT q, nq, 5 AS cost, 'I' AS audit FROM step WHERE c <> 's'),
ins2 AS MATERIALIZED (SELECT q, q AS nq, 0 AS cost, '' AS audit FROM range(4) r(q) UNION ALL SELECT * FROM ins
  UNION ALL SELECT a.q, b.nq, 10, 'II' FROM ins a JOIN ins b ON a.nq = b.q),
n AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
ed AS MATERIALIZED (
  SELECT conv_id, i, q, q AS nq, 2 AS cost, 'D' AS letter FROM f, range(4) r(q)
  UNION ALL SELECT conv_id, i, q, nq, CASE fault WHEN '' THEN 0 ELSE 5 END, 'K' FROM f JOIN step ON c = role[1:1] WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, q, nq, CASE fault WHEN '' THEN 1 ELSE 6 END, 'R' FROM f JOIN step ON c <> 's' WHERE fault IN ('', 'truncated')),
move AS MATERIALIZED (
  SELECT conv_id, i, s.q, e.nq, min(lpad((s.cost + e.cost)::VARCHAR, 9, '0') || s.audit || letter) AS w
  FROM ins2 s JOIN ed e ON e.q = s.nq GROUP BY ALL),
path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, '000000000' AS w FROM n
  UNION ALL
  SELECT p.conv_id, m.i, m.nq, min(lpad((p.w[1:9]::INTEGER + m.w[1:9]::INTEGER)::VARCHAR, 9, '0') || p.w[10:] || m.w[10:])
  FROM path p JOIN move m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1 AND m.q = p.q GROUP BY ALL),
best AS (SELECT path.conv_id, min(lpad((w[1:9]::INTEGER + s.cost)::VARCHAR, 9, '0') || w[10:] || s.audit) AS w
  FROM path JOIN n ON n.conv_id IS NOT DISTINCT FROM path.conv_id AND path.i = n.n JOIN ins2 s ON s.q = path.q WHERE s.nq IN (0, 3) GROUP BY path.conv_id),
letters AS (SELECT conv_id, w[9 + k:9 + k] AS letter, k FROM (SELECT conv_id, w, unnest(range(1, length(w) - 8)) AS k FROM best)),
placed AS (SELECT l.conv_id, l.letter, l.k, sum((letter <> 'I')::INTEGER) OVER (PARTITION BY l.conv_id ORDER BY k) AS i FROM letters l),
stays AS (SELECT p.conv_id, k, letter, f.role, f.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY k) AS at
  FROM placed p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE letter IN ('K', 'R')
  UNION ALL SELECT conv_id, k, letter, NULL, '', 1 FROM placed WHERE letter = 'I'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 - max((letter = 'K' AND role[1:1] = 's')::INTEGER) OVER (PARTITION BY conv_id) AS place FROM stays),
lines AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS body
  FROM ordered GROUP BY conv_id),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(w[1:9]::BIGINT, 0) AS cost, coalesce(w[10:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id
"""
