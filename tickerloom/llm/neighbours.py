"""Approximate nearest neighbours by a forest of random-projection trees under one priority queue, reranked exactly.

1. Classes. Rows of equal vectors form a class, named by its least vec_id; of its ids the least KEEP + 1 go on, as no
   query can be told more of them. So copies, however many, cost one row of the index.
2. Forest. TREES trees are grown on a sample of at most SAMPLE classes: a node splits at the median of the projection
   on the line between two means, down to LEAF sample rows. Only the trees are fitted on the sample; every class is
   indexed by its leaf in each tree.
3. Search. A query's queue holds nodes of all trees by the largest margin on their path. It yields leaves, nearest
   first, until the leaves hold as many rows as the search budget says.
4. Budget. It is fitted, not set: the true neighbours of CALIBRATION sampled rows are found by comparing these few with
   all rows, and the budget is the least with which TARGET of them lie in a visited leaf. It grows where vectors have
   no structure: there no index saves much, and the recall stays.
5. Rerank. Rows and queries of a leaf meet in groups of about ROWS rows and QUERIES queries (a full leaf is dealt to
   several groups, every query of it visits them all), sorted so that a task holds one group's rows and streams the
   queries. Cosines are computed in double precision on the original vectors; the best of every group meet by query.

Queries are rows whose vec_id is divisible by EVERY; candidates are all rows with another vec_id. Vectors that are null,
zero or hold null or non-finite components take no part, nor do rows without vec_id. Repeated rows count once; rows that
share a vec_id but not the vector are candidates each, and queries each. Ties go to the smaller vec_id. Fewer than KEEP
candidates give fewer rows, an empty table none. Vectors of several lengths are an error. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import small_side, written

EVERY = 50
KEEP = 5
TREES = 6
LEAF = 96
SAMPLE = 20_000
CALIBRATION = 256
TARGET = 0.97
ROWS = 1024
QUERIES = 4096

#: Cosines of a block are matrix products; pairs this close to the block's last place are computed one by one.
_NEAR = 1e-9


@dataclass(frozen=True)
class Forest:
    """Trees in arrays: an inner node has its two children, a leaf -1 - its number; leaves are numbered over all trees."""

    normal: np.ndarray
    offset: np.ndarray
    below: np.ndarray
    above: np.ndarray
    roots: np.ndarray
    leaves: int

    def margins(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.normal.T - self.offset

    def places(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        margins = self.margins(unit)
        out = np.empty((len(unit), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(unit), root)
            while len(inner := np.flatnonzero(self.below[at] >= 0)):
                node = at[inner]
                at[inner] = np.where(margins[inner, node] > 0, self.above[node], self.below[node])
            out[:, t] = -1 - self.below[at]
        return out

    def nearest_leaves(self, margin: np.ndarray) -> Iterator[int]:
        """Leaves of all trees, nearest first, by one queue; margin is the query's at every node."""
        queue = [(-1.0, int(root)) for root in self.roots]
        while queue:
            worst, node = heapq.heappop(queue)
            while (low := int(self.below[node])) >= 0:
                near, far = (int(self.above[node]), low) if margin[node] > 0 else (low, int(self.above[node]))
                heapq.heappush(queue, (max(worst, abs(float(margin[node]))), far))
                node = near
            yield -1 - low


def units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def grow(unit: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> Forest:
    """A forest over sample rows of length one."""
    normal, offset, below, above, roots = [], [], [], [], []
    leaves = 0
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        roots.append(len(below))
        todo = [(np.arange(len(unit)), -1, False)]
        while todo:
            rows, parent, right = todo.pop()
            node = len(below)
            if parent >= 0:
                (above if right else below)[parent] = node
            split = None
            if len(rows) > leaf:
                a, b = unit[rng.choice(rows, 2, replace=False)]
                for _ in range(3):
                    side = unit[rows] @ (a - b) > ((a + b) @ (a - b)) / 2
                    if side.all() or not side.any():
                        break
                    a, b = unit[rows[side]].mean(axis=0), unit[rows[~side]].mean(axis=0)
                line = a - b
                line = line / (np.linalg.norm(line) or 1.0)
                along = unit[rows] @ line
                middle = float(np.median(along))
                side = along > middle
                if side.any() and not side.all():
                    split = line, middle, side
            normal.append(split[0] if split else np.zeros(unit.shape[1]))
            offset.append(split[1] if split else 0.0)
            above.append(-1)
            if split:
                below.append(0)
                todo += [(rows[split[2]], node, True), (rows[~split[2]], node, False)]
            else:
                below.append(-1 - leaves)
                leaves += 1
    return Forest(np.array(normal), np.array(offset), np.array(below), np.array(above), np.array(roots), leaves)


def usable(vector: Column) -> Column:
    """No null, no NaN, nothing infinite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def vector_classes(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """name, ids and v of every distinct vector of (vec_id, v): its least id and its keep + 1 least ids.

    The row limit of the window applies before the exchange too, so copies cost keep + 1 rows a task.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep + 1)
    ids = F.array_sort(F.collect_list("vec_id"))
    return few.groupBy("v").agg(ids.alias("ids")).select(F.col("ids")[0].alias("name"), "ids", "v")


def best_of(names_q: np.ndarray, q: np.ndarray, names_r: np.ndarray, r: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """For every query its keep nearest rows: query names, row names, cosines; equal cosines by name."""
    q, r = q.astype(np.float64), r.astype(np.float64)
    nq, nr = np.sqrt((q * q).sum(axis=1)), np.sqrt((r * r).sum(axis=1))
    rough = (q @ r.T) / (nq[:, None] * nr)
    last = max(rough.shape[1] - keep, 0)
    i, j = np.nonzero(rough >= np.partition(rough, last, axis=1)[:, last, None] - _NEAR)
    score = (q[i] * r[j]).sum(axis=1) / (nq[i] * nr[j])
    order = np.lexsort((names_r[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    top = rank < keep
    return names_q[i[top]], names_r[j[top]], score[top]


_FOUND = "query bigint, name bigint, score double"


def _found(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], ["query", "name", "score"])


def fitted_budget(classes: DataFrame, forest: Forest, counts: np.ndarray, names: np.ndarray, vectors: np.ndarray, keep: int, target: float) -> int:
    """Rows to visit so that target of the true neighbours of the given few rows are among them.

    names and vectors are at most CALIBRATION rows; they are compared with all classes, batch by batch.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _found(best_of(names, vectors, batch.column(0).to_numpy(), _matrix(batch.column(1)), keep + 1))

    order = Window.partitionBy("query").orderBy(F.desc("score"), "name")
    near = classes.select("name", "v").mapInArrow(compare, _FOUND)
    near = near.where("query <> name").withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    truth = near.join(classes.select("name", "v"), "name").select("query", "v").toArrow()
    if not truth.num_rows:
        return int(counts.sum())
    places = forest.places(units(_matrix(truth["v"].combine_chunks())))
    wanted: dict[int, list[set[int]]] = {}
    for query, leaves in zip(truth["query"].to_pylist(), places, strict=True):
        wanted.setdefault(query, []).append(set(leaves.tolist()))
    margins = forest.margins(units(vectors))
    seen_at = []
    for name, margin in zip(names.tolist(), margins, strict=True):
        open_, seen = list(wanted.get(name, [])), 0
        for leaf in forest.nearest_leaves(margin):
            if not open_:
                break
            seen += int(counts[leaf])
            left = [x for x in open_ if leaf not in x]
            seen_at += [seen] * (len(open_) - len(left))
            open_ = left
    return int(np.quantile(np.array(seen_at), target, method="higher"))


def _streamed(keep: int):
    """Rows sorted by group with a group's index rows first: holds those, and answers its queries batch by batch."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            names, vectors = batch.column(4).to_numpy(), _matrix(batch.column(5))
            starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]).any(axis=1)])
            for a, b in zip(starts, np.r_[starts[1:], len(table)], strict=True):
                group, is_query = tuple(table[a, :3].tolist()), bool(table[a, 3])
                if group != key:
                    key, held = group, []
                if not is_query:
                    held.append((names[a:b], vectors[a:b]))
                elif held:
                    if len(held) > 1:
                        held = [(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                    yield _found(best_of(names[a:b], vectors[a:b], *held[0], keep))

    return score


def nearest(rows: DataFrame, queries: DataFrame, keep: int = KEEP, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, budget: int | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the keep nearest rows found of every query; both frames have vec_id and embedding.

    Every query has to be among rows. budget is the number of rows to visit for a query; by default it is fitted.
    """
    index_rows, query_rows = (x.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint"), F.col("embedding").alias("v")) for x in (rows, queries))
    classes = written(vector_classes(index_rows, keep), "vectors")
    lengths = [r[0] for r in classes.groupBy(F.size("v")).count().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("vectors of several lengths can't be compared")
    found_schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return rows.sparkSession.createDataFrame([], found_schema)
    fit = classes.orderBy(F.xxhash64("name"), "name").limit(sample).select("name", "v").toArrow()
    fit_names, fit_vectors = fit["name"].to_numpy(), _matrix(fit["v"].combine_chunks())
    forest = grow(units(fit_vectors), trees, leaf)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.places(units(_matrix(batch.column(1))))
            ends = np.arange(len(leaves) + 1, dtype=np.int32) * len(forest.roots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, leaves.ravel())], [*batch.schema.names, "leaves"])

    kind = classes.schema["v"].dataType.simpleString()
    index = written(classes.select("name", "v").mapInArrow(place, f"name bigint, v {kind}, leaves array<int>"), "index")
    counts = np.zeros(forest.leaves, dtype=np.int64)
    for at, n in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        counts[at] = n
    if budget is None:
        budget = fitted_budget(classes, forest, counts, fit_names[:CALIBRATION], fit_vectors[:CALIBRATION], keep, target)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            visited = []
            for margin in forest.margins(units(_matrix(batch.column(1)))):
                some, n = [], 0
                for at in forest.nearest_leaves(margin):
                    if n >= budget:
                        break
                    some.append(at)
                    n += int(counts[at])
                visited.append(some)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visited, pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    named = written(query_rows.distinct().join(classes.select("name", "v"), "v").select("vec_id", "name"), "queries")
    asked = classes.select("name", "v").join(named.select("name").distinct(), "name", "left_semi")
    visits = written(asked.mapInArrow(visit, f"name bigint, v {kind}, leaves array<int>"), "visits")

    # A row per leaf, so bounded by the sample: how many groups its rows and its queries are dealt to.
    asked_of = visits.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    groups = [(i, max(1, -(-int(n) // ROWS))) for i, n in enumerate(counts)]
    plan = F.broadcast(asked_of.join(rows.sparkSession.createDataFrame(groups, "leaf int, parts int"), "leaf"))
    dealt = index.withColumn("leaf", F.explode("leaves")).join(plan, "leaf")
    dealt = dealt.selectExpr("leaf", "CAST(pmod(xxhash64(name, 1), parts) AS int) AS part", "explode(sequence(0, shares - 1)) AS share", "0 AS asks", "name", "v")
    asks = visits.withColumn("leaf", F.explode("leaves")).join(plan, "leaf")
    asks = asks.selectExpr("leaf", "explode(sequence(0, parts - 1)) AS part", "CAST(pmod(xxhash64(name, 2), shares) AS int) AS share", "1 AS asks", "name", "v")
    met = dealt.unionByName(asks).repartition("leaf", "part", "share").sortWithinPartitions("leaf", "part", "share", "asks")
    found = met.mapInArrow(_streamed(keep + 1), _FOUND).repartition("query").groupBy("query", "name").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "name")
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep + 1)

    ids = top.join(classes.select("name", "ids"), "name").select(F.col("query").alias("name"), F.explode("ids").alias("vec_id"), "score")
    lists = ids.groupBy("name").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")).alias("all"))
    answers = named.withColumnRenamed("vec_id", "query_id").join(small_side(lists), "name")
    others = F.slice(F.array_sort(F.filter("all", lambda x: x["vec_id"] != F.col("query_id"))), 1, keep)
    ranked = answers.select("query_id", F.posexplode(others).alias("pos", "one"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.far")).alias("score"))


def nearest_of_every(rows: DataFrame, every: int = EVERY, **how) -> DataFrame:
    """nearest() for the rows whose vec_id is divisible by every, against all rows."""
    return nearest(rows, rows.where(F.col("vec_id") % every == 0), **how)
