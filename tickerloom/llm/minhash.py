"""Near-duplicate detection by HyperMinHash signatures, banded, estimated and then verified on full sets.

A text's set holds its distinct WIDTH-word shingles (A-Z lower-cased, words between ASCII white space); a shorter text
is one shingle; a text without words has an empty set and is linked with nothing. Two texts are linked if
100 * intersection >= PERCENT * union.

1. Signatures. A shingle's hash picks one of REGISTERS buckets and leaves a rest; a bucket stores of its least rest the
   count of leading zeros and the MANTISSA bits after the first one, 16 bits in all. Buckets left empty borrow the
   register of the first filled bucket in an order of their own, so that small sets have whole signatures too.
2. Texts with equal sets form a class; only the class goes on. ROWS neighbouring registers form a band, whose 64 bits
   are its key without further hashing; a pair at the threshold shares no band with a chance of about 5e-6.
3. Every class of a band's bucket is compared with the bucket's least and largest class. A pair's Jaccard index is
   estimated from equal registers, corrected for accidental collisions; what may reach the threshold is verified on
   the two texts' full sets. Verified links give components.
4. Buckets whose classes still lie in several components are finished exactly: classes outside the bucket's largest
   component are a query set against all of its classes, in blocks of BLOCK. A pair is looked at in its first common
   band only, and never within one component. What passes the estimate is verified block by block, and components
   are final.

So no pairs within a group are listed, and every link between components is found that two chances let through: a pair
shares no band (5e-6 at J = 0.75, 5e-8 at 0.8, less above), or its estimate falls MARGIN short of the threshold (four
standard errors, 3e-5). With margin = 1 every pair that shares a band and is close in size is verified, whatever its
estimate; the first chance stays.

Null text is empty text. Rows with a null doc_id can't be linked and stay. Repeated rows are copies of one another and
share verdicts. An empty table gives an empty result. Columns of docs other than doc_id and text are not read;
filtering keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import fresh, small_side, written
from tickerloom.operators.components import components

WIDTH = 5
PERCENT = 75
REGISTERS = 128
BUCKET_BITS = 7
MANTISSA = 10
ROWS = 4
BANDS = REGISTERS // ROWS
BLOCK = 256
#: An estimate has a standard error of 0.04 at the threshold; pairs more than 4 of them below are not verified.
MARGIN = 0.16

_REST_BITS = 53
_ORDERS = np.stack([np.random.default_rng(b).permutation(REGISTERS) for b in range(REGISTERS)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a UTF-8 text's set."""
    import xxhash

    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    span = min(n, width)
    total = np.full(n - span + 1, span, dtype=np.uint64)
    for k in range(span):
        total = total * np.uint64(0x2545F4914F6CDD1D) + one[k : n - span + 1 + k]
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS registers of a set that is not empty."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(64 - _REST_BITS)
    part, bits = np.frexp(rest.astype(np.float64))
    zeros = _REST_BITS - bits
    mantissa = np.where(rest > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[bucket[first]] = (zeros.astype(np.int64) << MANTISSA) | mantissa
    if len(first) < REGISTERS:
        filled = np.zeros(REGISTERS, dtype=bool)
        filled[bucket[first]] = True
        empty = np.flatnonzero(~filled)
        orders = _ORDERS[empty]
        out[empty] = out[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
    return out


@lru_cache(maxsize=1)
def collision_table() -> np.ndarray:
    """Chance that unrelated registers agree, by the binary logarithms of the two sets' sizes."""
    low = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for z in range(32)])
    width = np.repeat([2.0 ** -(z + 1 + MANTISSA) for z in range(32)], 1 << MANTISSA)
    loads = [max(2.0**k / REGISTERS, 1.0) for k in range(32)]
    cells = np.stack([np.exp(-x * low) * -np.expm1(-x * width) if x > 1 else width for x in loads])
    return cells @ cells.T


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers a and b for sets of sizes n_a and n_b."""
    agree = (a == b).mean(axis=-1)
    chance = collision_table()[np.log2(n_a).astype(int).clip(0, 31), np.log2(n_b).astype(int).clip(0, 31)]
    return np.maximum(0.0, (agree - chance) / (1 - chance))


def _registers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("<i8").view("<u2").reshape(-1, REGISTERS)


def _close_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), mark (the set's 128-bit digest) and bands (its registers, ROWS to a number; null if empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, marks, bands = [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py() or b"")
                sizes.append(len(hashes))
                marks.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                bands.append(signature(hashes).view("<i8") if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "mark", "bands"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(sign, "doc_id bigint, n bigint, mark binary, bands array<bigint>")


def _promising(pairs: DataFrame, classes: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Of pairs (a, b) those whose estimate may reach the threshold."""
    sides = [classes.select(F.col("class_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bands").alias(f"bands_{s}")) for s in "ab"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(i).to_numpy() for i in (2, 4))
                likely = estimate(_registers(batch.column(3)), _registers(batch.column(5)), n_a, n_b) >= PERCENT / 100 - margin
                yield batch.select(["a", "b"]).filter(pa.array(likely & _close_sizes(n_a, n_b)))

    wide = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "bands_a", "n_b", "bands_b")
    return wide.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")).mapInArrow(pick, "a bigint, b bigint")


def _texts(ids: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """id and text of the documents named in ids; written to the shared folder."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("binary").alias("text")).join(small_side(ids.distinct()), "id", "left_semi")
    return written(texts.dropDuplicates(["id"]), f"{label}-texts")


def _linked(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(left) + len(right) - both)


def verified(pairs: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """Of pairs (a, b) of doc_ids those linked on full sets; written to the shared folder."""
    texts = _texts(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), docs, label)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(key: int, text: pa.Scalar) -> np.ndarray:
            got = held.get(key)
            if got is None:
                if len(held) >= 256:
                    held.clear()
                got = held[key] = shingles(text.as_py() or b"")
            return got

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [_linked(of(x, batch.column(2)[i]), of(y, batch.column(3)[i])) for i, (x, y) in enumerate(zip(a, b, strict=True))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    wide = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")
    return written(wide.mapInArrow(confirm, "a bigint, b bigint"), f"{label}-links")


def _unsettled(members: DataFrame, classes: DataFrame, roots: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Promising pairs between components, from buckets that hold several; members: band, key, class_id.

    A row per block and class in such a pair: block, id, root and partners, the ids it is to be verified with there.
    """
    rows = members.join(roots, F.col("class_id") == F.col("node"), "left").select("band", "key", "class_id", F.coalesce("root", "class_id").alias("root"))
    shares = rows.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("c"))
    buckets = shares.groupBy("band", "key").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("all"), F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most")).where("roots > 1")
    n_q, n_t = F.ceil((F.col("all") - F.col("most")) / BLOCK), F.ceil(F.col("all") / BLOCK)
    mixed = rows.join(buckets.select("band", "key", "main", n_q.alias("n_q"), n_t.alias("n_t")), ["band", "key"])
    mixed = mixed.join(classes.select("class_id", "n", "bands"), "class_id").withColumn("asks", F.col("root") != F.col("main"))
    place = F.xxhash64("class_id")
    queries = mixed.where("asks").withColumns({"q": F.pmod(place, "n_q"), "t": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_t") - 1))}).withColumn("asked", F.lit(False))
    targets = mixed.withColumns({"t": F.pmod(place, "n_t"), "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_q") - 1))}).withColumn("asked", F.lit(True))
    columns = ["band", "key", "q", "t", "asked", "class_id", "root", "asks", "n", "bands"]
    blocks = queries.select(columns).union(targets.select(columns)).repartition("band", "key", "q", "t").sortWithinPartitions("band", "key", "q", "t", "asked")

    def compare(table: pa.Table) -> pa.RecordBatch:
        import xxhash

        asked = table["asked"].to_numpy()
        ids, roots_, asks, n = (table[c].to_numpy() for c in ("class_id", "root", "asks", "n"))
        block = np.array([table[c][0].as_py() for c in ("band", "key", "q", "t")], dtype=np.int64)
        registers = _registers(table["bands"].combine_chunks())
        q, t = np.flatnonzero(~asked), np.flatnonzero(asked)
        partners: dict[int, list[int]] = {}
        for i in q:
            js = t[(roots_[t] != roots_[i]) & _close_sizes(n[t], n[i]) & (~asks[t] | (ids[i] < ids[t]))]
            if len(js):
                same = registers[js] == registers[i]
                js = js[same.reshape(len(js), BANDS, ROWS).all(axis=2).argmax(axis=1) == block[0]]
            if len(js):
                js = js[estimate(registers[js], registers[i], n[js], np.full(len(js), n[i])) >= PERCENT / 100 - margin]
            if len(js):
                partners.setdefault(int(ids[i]), []).extend(ids[js].tolist())
                for j in ids[js].tolist():
                    partners.setdefault(j, [])
        root_of = dict(zip(ids.tolist(), roots_.tolist(), strict=True))
        name = int(np.uint64(xxhash.xxh3_64_intdigest(block.tobytes())).astype(np.int64))
        columns = [[name] * len(partners), list(partners), [root_of[i] for i in partners]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(list(partners.values()), pa.list_(pa.int64()))], ["block", "id", "root", "partners"])

    return blocks.mapInArrow(_by_group(compare, ["band", "key", "q", "t"]), "block bigint, id bigint, root bigint, partners array<bigint>")


def _by_group(run: Callable[[pa.Table], pa.RecordBatch], by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls run for rows that follow one another with equal values in by; a group is about two blocks at most."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
            keys = np.stack([table[c].to_numpy() for c in by])
            start = 0
            for end in np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1:
                yield run(table.slice(start, end - start))
                start = end
            rest = table.slice(start)
        if rest is not None and rest.num_rows:
            yield run(rest)

    return grouped


def verified_blocks(members: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """Links (a, b) between components, verified on full sets; written to the shared folder.

    Every block gets its members' texts once, however many pairs they are in. Of a block's links those are kept that
    join components not yet joined in it: fewer than its members, and the same components in the end.
    """
    texts = _texts(members.select("id"), docs, label)
    wide = members.join(texts, "id").select("block", "id", "root", "partners", "text").repartition("block").sortWithinPartitions("block")

    def settle(table: pa.Table) -> pa.RecordBatch:
        ids, roots = table["id"].to_pylist(), table["root"].to_pylist()
        root_of, above = dict(zip(ids, roots, strict=True)), {r: r for r in roots}
        sets = {i: shingles(t.as_py() or b"") for i, t in zip(ids, table["text"], strict=True)}

        def top(r: int) -> int:
            while above[r] != r:
                above[r] = above[above[r]]
                r = above[r]
            return r

        links: list[tuple[int, int]] = []
        for i, others in zip(ids, table["partners"].to_pylist(), strict=True):
            for j in others:
                x, y = top(root_of[i]), top(root_of[j])
                if x != y and _linked(sets[i], sets[j]):
                    above[x] = y
                    links.append((i, j))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return written(wide.mapInArrow(_by_group(settle, ["block"]), "a bigint, b bigint"), f"{label}-links")


def near_components(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    signed = written(signatures(docs), "minhash-signatures")
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy("n", "mark").agg(F.min("doc_id").alias("class_id"), F.max("bands").alias("bands")), "minhash-classes")

    banded = classes.select("class_id", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c"), F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("c > 1").drop("c")
    members = written(banded.join(buckets, ["band", "key"]), "minhash-members")

    leaders = F.explode(F.array("low", "high")).alias("leader")
    stars = members.select("class_id", leaders).where("class_id <> leader").select(F.greatest("class_id", "leader").alias("a"), F.least("class_id", "leader").alias("b")).distinct()
    pairs = written(_promising(stars, classes, margin), "minhash-stars")
    links = verified(pairs, docs, "minhash-stars")
    roots = components(links)

    more = written(_unsettled(members.select("band", "key", "class_id"), classes, roots, margin), "minhash-unsettled")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified_blocks(more, docs, "minhash-unsettled")))

    ids = classes.select("n", "mark", "class_id").join(roots, F.col("class_id") == F.col("node"), "left").select("n", "mark", F.coalesce("root", "class_id").alias("component_id"))
    joined = signed.select("doc_id", "n", "mark").join(ids, ["n", "mark"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: the document of least doc_id of every component."""
    name = fresh(docs, "gone")
    gone = written(near_components(docs).where("NOT kept").select(F.col("doc_id").alias(name)), "minhash-gone")
    return docs.join(small_side(gone), F.col("doc_id") == F.col(name), "left_anti")
