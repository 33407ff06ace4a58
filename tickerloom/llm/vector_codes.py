"""Vector code compression: integer codebooks per part of a vector, refined over metric trees built middle-out.

A component x becomes floor(4096 * x); vectors are cut into PARTS equal parts. A part's codebook starts as that part of
the ENTRIES vectors of least vec_id. Each of ROUNDS rounds assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves an entry to the floor of its parts' mean; unused entries stay. The last
codebooks give the codes. All arithmetic that decides is on integers, so any order of rows gives the same result.

Trees. Rows are taken in chunks of at most CHUNK; a chunk gets one tree per part. Anchors take the points nearest to
them, a new anchor being the farthest point of the widest ball and stealing only what the triangle inequality leaves
open; about the square root of the points become anchors, each is divided in the same way, and anchors are merged upward,
the two with the smallest common ball first. A ball caches its points' sum and count. The table of chunks is written
once; rounds read it.

Rounds. A ball inherits its parent's list of candidate entries and drops those that lie wholly on the far side of the
bisector with its best entry. A ball with one candidate left is wholly owned: its cached sum and count are added and no
point below is looked at. Leaves compare their points with what is left of the list. A task adds up PARTS * ENTRIES sums,
which are aggregated; the driver sees the codebooks only.

Vectors that are null or hold null or non-finite components are dropped. A null vec_id gets a code and starts no
codebook; rows that repeat a vec_id get a code each, and of several vectors of one id the least starts a codebook. With
fewer than ENTRIES ids codebooks are shorter; without any id, or in an empty table, there is nothing to code by: that gives an empty result. Null labels are one label. Vectors
of several lengths, of a length that PARTS does not divide, or so large that squared distances exceed 64 bits are
errors. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import small_side, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
CHUNK = 4096
LEAF = 16

#: Bounds are doubles: a candidate goes only if it is beaten by more than this share of the distances.
_SLACK = 1e-9


@dataclass
class Tree:
    """Balls over points in tree order: a ball's points are start..end, its children left and right, -1 at a leaf."""

    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    TYPES = ("<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<f8", "<f8", "<i8")

    def packed(self) -> dict[str, bytes]:
        return {f.name: getattr(self, f.name).astype(t).tobytes() for f, t in zip(fields(self), self.TYPES, strict=True)}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], width: int) -> Tree:
        wide = {"points", "pivot", "sums"}
        arrays = {f.name: np.frombuffer(row[f.name], t) for f, t in zip(fields(cls), cls.TYPES, strict=True)}
        return cls(**{k: a.reshape(-1, width) if k in wide else a for k, a in arrays.items()})


def anchors(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the balls of at most so many anchors."""

    def from_anchor(rows: np.ndarray, anchor: int) -> np.ndarray:
        return np.sqrt(((points[rows] - points[anchor]) ** 2).sum(axis=1))

    every = np.arange(len(points))
    chosen = [0]
    owner = np.zeros(len(points), dtype=np.int64)
    away = from_anchor(every, 0)
    while len(chosen) < most:
        new = int(away.argmax())
        if away[new] == 0:
            break
        between = from_anchor(np.array(chosen), new)
        open_ = np.flatnonzero(away > between[owner] / 2)
        near = from_anchor(open_, new)
        stolen = near < away[open_]
        owner[open_[stolen]], away[open_[stolen]] = len(chosen), near[stolen]
        chosen.append(new)
    return [rows for k in range(len(chosen)) if len(rows := np.flatnonzero(owner == k))]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of a chunk's integer points."""
    wide = points.astype(np.float64)
    nodes: list[tuple[np.ndarray | None, int, int]] = []

    def add(rows: np.ndarray | None, left: int = -1, right: int = -1) -> int:
        nodes.append((rows, left, right))
        return len(nodes) - 1

    def middle_out(rows: np.ndarray) -> int:
        balls = anchors(wide[rows], max(2, math.isqrt(len(rows)))) if len(rows) > leaf else []
        if len(balls) < 2:
            return add(rows)
        at = [middle_out(rows[b]) for b in balls]
        weight = np.array([len(b) for b in balls], dtype=float)
        centre = np.stack([wide[rows[b]].mean(axis=0) for b in balls])
        reach = np.array([np.sqrt(((wide[rows[b]] - c) ** 2).sum(axis=1).max()) for b, c in zip(balls, centre, strict=True)])
        common = (np.sqrt(((centre[:, None] - centre) ** 2).sum(axis=2)) + reach[:, None] + reach) / 2
        np.fill_diagonal(common, np.inf)
        for _ in range(len(at) - 1):
            i, j = divmod(int(common.argmin()), len(at))
            at[i] = add(None, at[i], at[j])
            both = weight[i] + weight[j]
            middle = (centre[i] * weight[i] + centre[j] * weight[j]) / both
            reach[i] = max(np.sqrt(((centre[k] - middle) ** 2).sum()) + reach[k] for k in (i, j))
            centre[i], weight[i] = middle, both
            common[j, :] = common[:, j] = np.inf
            gone = np.isinf(common[i])
            row = (np.sqrt(((centre - middle) ** 2).sum(axis=1)) + reach + reach[i]) / 2
            row[gone] = np.inf
            common[i, :] = common[:, i] = row
        return len(nodes) - 1

    root = middle_out(np.arange(len(points)))
    n = len(nodes)
    start, end, todo, order, filled = np.zeros(n, np.int64), np.zeros(n, np.int64), [(root, False)], [], 0
    while todo:
        node, done = todo.pop()
        rows, left, right = nodes[node]
        if rows is not None:
            order.append(rows)
            start[node], filled = filled, filled + len(rows)
            end[node] = filled
        elif done:
            start[node], end[node] = start[left], end[right]
        else:
            todo += [(node, True), (right, False), (left, False)]
    placed = np.concatenate(order)
    points, wide = points[placed], wide[placed]
    sums = np.stack([points[a:b].sum(axis=0, dtype=np.int64) for a, b in zip(start, end, strict=True)])
    pivot, radius = np.empty(sums.shape), np.empty(n)
    for i, (a, b) in enumerate(zip(start, end, strict=True)):
        alike = (points[a:b] == points[a]).all()
        pivot[i] = points[a] if alike else sums[i] / (b - a)
        radius[i] = 0.0 if alike else np.sqrt(((wide[a:b] - pivot[i]) ** 2).sum(axis=1).max()) * (1 + _SLACK)
    left, right = (np.array([x[k] for x in nodes]) for k in (1, 2))
    # The root comes first, whatever its number.
    first = np.r_[root, np.delete(np.arange(n), root)]
    number = np.empty(n + 1, dtype=np.int64)
    number[first], number[-1] = np.arange(n), -1
    return Tree(placed, points, start[first], end[first], number[left[first]], number[right[first]], pivot[first], radius[first], sums[first])


def _nearest(points: np.ndarray, book: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance, in integers, of each point's nearest entry among those open to it."""
    gap = points[:, None].astype(np.int64) - book
    far = np.where(open_, (gap * gap).sum(axis=2), np.iinfo(np.int64).max)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def ownership(tree: Tree, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]], int]:
    """Balls wholly owned with their entries; points of other leaves with theirs; distances computed on the way."""
    entries = book.astype(np.float64)
    apart = np.sqrt(((entries[:, None] - entries) ** 2).sum(axis=2))
    first = np.array([not (book[:i] == book[i]).all(axis=1).any() for i in range(len(book))])
    balls, loose, distances = [], [], 0
    at, open_ = np.zeros(1, dtype=np.int64), first[None, :]
    while len(at):
        far = np.where(open_, ((tree.pivot[at][:, None] - entries) ** 2).sum(axis=2), np.inf)
        distances += int(open_.sum())
        best = far.argmin(axis=1)
        least = far[np.arange(len(at)), best][:, None]
        beaten = far - least > 2 * tree.radius[at][:, None] * apart[best] + _SLACK * (far + least)
        open_ = open_ & ~beaten
        exact = tree.radius[at] == 0
        if exact.any():
            owner, _ = _nearest(tree.pivot[at[exact]].astype(np.int64), book, open_[exact])
            open_[exact] = np.arange(len(book)) == owner[:, None]
        owned = open_.sum(axis=1) == 1
        balls.append((at[owned], open_[owned].argmax(axis=1)))
        leaf = ~owned & (tree.left[at] < 0)
        if leaf.any():
            size = tree.end[at[leaf]] - tree.start[at[leaf]]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(tree.start[at[leaf]], tree.end[at[leaf]], strict=True)])
            lists = np.repeat(open_[leaf], size, axis=0)
            distances += int(lists.sum())
            loose.append((rows, _nearest(tree.points[rows], book, lists)[0]))
        down = ~owned & ~leaf
        at = np.concatenate([tree.left[at[down]], tree.right[at[down]]]).astype(np.int64)
        open_ = np.concatenate([open_[down], open_[down]])
    return balls, loose, distances


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of every entry's points."""
    n, s = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    balls, loose, _ = ownership(tree, book)
    for nodes, owner in balls:
        np.add.at(n, owner, tree.end[nodes] - tree.start[nodes])
        np.add.at(s, owner, tree.sums[nodes])
    for rows, owner in loose:
        np.add.at(n, owner, 1)
        np.add.at(s, owner, tree.points[rows].astype(np.int64))
    return n, s


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the chunk's order."""
    placed = np.empty(len(tree.order), dtype=np.int64)
    balls, loose, _ = ownership(tree, book)
    for nodes, owner in balls:
        for node, k in zip(nodes, owner, strict=True):
            placed[tree.start[node] : tree.end[node]] = k
    for rows, owner in loose:
        placed[rows] = owner
    gap = tree.points.astype(np.int64) - book[placed]
    entry, error = np.empty_like(placed), np.empty_like(placed)
    entry[tree.order], error[tree.order] = placed, (gap * gap).sum(axis=1)
    return entry, error


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite, F.lit(False))


_TREE = ", ".join(f"{f.name}: binary" for f in fields(Tree))


def tree_table(rows: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """A row per chunk of (vec_id, label, v): its ids, labels and the trees of its parts."""
    limit = math.isqrt((1 << 63) // (width * PARTS)) // 2

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                piece = batch.slice(a, chunk)
                points = piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                if np.abs(points).max() > limit:
                    raise ValueError(f"components beyond {limit} have squared distances beyond 64 bits")
                trees = [build(points[:, p * width : (p + 1) * width]).packed() for p in range(PARTS)]
                ends = pa.array([0, piece.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, piece.column(c)) for c in range(2)]
                kind = pa.list_(pa.struct([(f.name, pa.binary()) for f in fields(Tree)]))
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], kind)], ["ids", "labels", "trees"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(plant, f"ids array<bigint>, labels array<{label}>, trees array<struct<{_TREE}>>")


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The vectors of the least entries ids, a row each."""
    ids = [r[0] for r in rows.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return np.zeros((0, 0), dtype=np.int64)
    least = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(least, key=lambda r: r["vec_id"])], dtype=np.int64)


def refined(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: PARTS codebooks of integer entries, moved to the floors of their parts' means."""
    parts, entries, width = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for chunk in batch.column(0):
                for p, tree in enumerate(chunk.as_py()):
                    some, total = totals(Tree.unpacked(tree, width), books[p])
                    n[p] += some
                    s[p] += total
        part, entry = np.divmod(np.arange(parts * entries), entries)
        sums = [pa.array(x) for x in s.reshape(-1, width).T]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n.ravel()), *sums], names)

    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
    sums = trees.select("trees").mapInArrow(add_up, ", ".join(f"{c} bigint" for c in names))
    out = books.copy()
    for row in sums.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]]).where("n > 0").collect():
        out[row["part"], row["entry"]] = [row[c] // row["n"] for c in names[3:]]
    return out


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors (vec_id, embedding, label)."""
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", whole_numbers(F.col("embedding")).alias("v"))
    schema = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    lengths = [r[0] for r in rows.groupBy(F.size("v")).count().limit(2).collect()]
    if len(lengths) > 1 or any(n % PARTS for n in lengths):
        raise ValueError(f"vectors need one length that {PARTS} divides")
    start = first_codebooks(rows, entries)
    if not start.size:
        return vectors.sparkSession.createDataFrame([], schema)
    width = lengths[0] // PARTS
    books = start.reshape(len(start), PARTS, width).transpose(1, 0, 2).copy()
    trees = written(tree_table(rows, width), "trees")
    for _ in range(rounds):
        books = refined(trees, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, chunk in zip(*(batch.column(c) for c in range(3)), strict=True):
                found = [assigned(Tree.unpacked(tree, width), books[p]) for p, tree in enumerate(chunk.as_py())]
                codes = np.stack([f[0] for f in found], axis=1)
                text = [bytes(row).hex() for row in codes.astype(np.uint8)]
                error = np.sum([f[1] for f in found], axis=0)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    codes = written(trees.mapInArrow(encode, f"vec_id bigint, label {label}, code string, error bigint"), "codes")
    by_label = small_side(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same result by plain comparison, a step per round."""

    def nearest(book: str) -> str:
        return f"""SELECT vec_id, label, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d
  FROM (SELECT vec_id, label, part, entry, sum((p.v - b.v) * (p.v - b.v)) AS d FROM p JOIN {book} b USING (part, pos) GROUP BY ALL)
  GROUP BY ALL"""

    steps = "".join(
        f""",
a{k} AS MATERIALIZED ({nearest(f"b{k}")}),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.v) AS v
  FROM b{k} b LEFT JOIN (SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM a{k} JOIN p USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))"""
        for k in range(rounds)
    )
    return f"""
WITH rows AS (SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS pos,
  floor({SCALE} * embedding[i]::DOUBLE)::HUGEINT AS v
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM rows)),
b0 AS MATERIALIZED (SELECT part, entry, pos, v FROM p JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM rows QUALIFY entry < {entries}) USING (vec_id)){steps},
last AS MATERIALIZED ({nearest(f"b{rounds}")}),
codes AS (SELECT vec_id, label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM codes
"""
