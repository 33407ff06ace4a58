"""Keyword search over a stored table by lists of the rows that hold a trigram, then the regular expression on what is left.

The index is made of segments. A segment covers some of the table's partition folders; it holds, per trigram (three code
points of a text, upper and lower case alike) and chunk of rows, the keys of the rows with it, in folders by hash of the trigram.
refresh() adds a segment for folders that the table's newest version names and no segment covers, so that a merge costs
the index what it rewrote; folders that are gone are passed over, and once they are the greater part all is built anew.

A search takes the trigrams that its pattern cannot match without, reads how many rows each has, and intersects the lists
of the RAREST few. It opens the segments' folders of those trigrams and the table's folders that candidates lie in, no
others. Patterns that guarantee no trigram (short ones, alternatives, groups) scan the table instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.search import filtered
from tickerloom.sources.scratch import scratch_table
from tickerloom.sources.versioned import PART, Journal, VersionConflict, VersionedTable

BUCKETS = 32
#: Rows of a folder that share a list, at most about so many.
CHUNK_ROWS = 8192
RAREST = 3
#: Text that a task holds before it hands its lists on.
FLUSH_CHARS = 1 << 22
#: Candidates that are broadcast to the table's folders after counting; more of them meet the rows by shuffle.
BROADCAST_ROWS = 200_000



class _Fold(dict):
    """Code point -> what matching without case takes it for, one for one as in regular expressions."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        upper = c.upper() if len(c.upper()) == 1 else c
        self[point] = upper.lower()[0]
        return self[point]


_FOLD = _Fold()
_LISTS = "folder string, chunk int, bucket int, gram string, n bigint, ids array<string>"


def grams_of(text: str) -> set[str]:
    text = text.translate(_FOLD)
    return {text[i : i + 3] for i in range(len(text) - 2)}


def bucket_of(gram: str, buckets: int = BUCKETS) -> int:
    return xxhash.xxh64_intdigest(gram.encode()) % buckets


def needed_grams(pattern: str) -> set[str]:
    """Trigrams of every text that the pattern matches, whatever its case; empty if none is certain."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c in "|()":
            return set()
        if c in "?*{":
            # What they follow may be absent.
            runs.append(run[:-1])
            run = ""
            if c == "{":
                i = pattern.find("}", i) if "}" in pattern[i:] else len(pattern)
        elif c == "\\":
            after = pattern[i + 1 : i + 2]
            if not after or after.isalnum():
                return set()
            run += after
            i += 1
        elif c == "[":
            runs.append(run)
            run = ""
            end = pattern.find("]", i + 2)
            if end < 0 or "[" in pattern[i + 1 : end] or "&&" in pattern[i:end] or "\\" in pattern[i:end]:
                return set()
            i = end
        elif c in ".^$+":
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    return set().union(*(grams_of(r) for r in [*runs, run]))


def _whole_lists(parts: DataFrame) -> DataFrame:
    """One list per trigram, folder and chunk of what tasks listed; dealt by bucket once, so that the grouping has no
    exchange of its own. Lists of a chunk are bounded by its rows; within a bucket they lie by trigram, so that row groups are skipped."""
    whole = parts.repartition("bucket").groupBy("bucket", "gram", "folder", "chunk").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"))
    return whole.sortWithinPartitions("bucket", "gram")


@dataclass
class _Segments:
    """The folders covered by each segment of a version of the index."""

    number: int
    covered: dict[str, list[str]]


class GramIndex(Journal):
    """An index at path over the text columns of a stored table whose rows are known by the string column key."""

    def __init__(self, table: VersionedTable, path: str, columns: tuple[str, ...] = ("title", "content"), key: str = "event_id"):
        super().__init__(table.spark, path)
        self.table, self.columns, self.key = table, columns, key

    def _segments(self) -> _Segments:
        known = self.versions()
        return _Segments(known[-1], self._get(known[-1])) if known else _Segments(-1, {})

    def refresh(self) -> int:
        """Covers the table's newest version; returns how many of its folders were read for it."""
        manifest = self.table.manifest()
        live = {folder: (part, n) for part, (folder, n) in manifest.parts.items()} if manifest else {}
        have = self._segments()
        covered = {f for fs in have.covered.values() for f in fs}
        anew = len(covered & set(live)) * 2 < len(covered)
        missing = sorted(set(live) - (set() if anew else covered))
        if not missing and not anew:
            return 0
        segments = {} if anew else dict(have.covered)
        if missing:
            name = f"segments/{uuid.uuid4().hex}"
            self._write(manifest, {f: live[f] for f in missing}, name)
            segments[name] = missing
        try:
            self._put(have.number + 1, segments)
        except VersionConflict:  # another refresh was first; what it left out is done now
            return self.refresh()
        return len(missing)

    def _write(self, manifest, folders: dict[str, tuple[str, int]], name: str) -> None:
        # A row per partition folder of the manifest.
        places = self.spark.createDataFrame([(part, folder, max(1, -(-n // CHUNK_ROWS))) for folder, (part, n) in folders.items()], "part string, folder string, chunks int")
        rows = self.table._partitioned(self.table._rows(manifest, [part for part, _ in folders.values()]))
        placed = rows.join(F.broadcast(places), F.col(PART) == F.col("part"))
        chunk = F.pmod(F.xxhash64(self.key), F.col("chunks")).cast("int")
        text = F.concat_ws("\n\n", *[F.col(c) for c in self.columns])

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, int, str], list[str]] = {}
            chars = 0

            def out() -> pa.RecordBatch:
                keys = list(held)
                columns = [[k[0] for k in keys], [k[1] for k in keys], [bucket_of(k[2]) for k in keys], [k[2] for k in keys], [len(held[k]) for k in keys], list(held.values())]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string())]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["folder", "chunk", "bucket", "gram", "n", "ids"])

            for batch in batches:
                for folder, number, key, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for gram in grams_of(told):
                        held.setdefault((folder, number, gram), []).append(key)
                    chars += len(told)
                    if chars >= FLUSH_CHARS:
                        yield out()
                        held, chars = {}, 0
            yield out()

        parts = placed.where(F.col(self.key).isNotNull()).select("folder", chunk.alias("chunk"), self.key, text.alias("text")).mapInArrow(lists, _LISTS)
        _whole_lists(parts).write.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def lists(self, grams: set[str]) -> DataFrame:
        """gram, folder, chunk, n and ids of these trigrams in folders of the table's newest version."""
        manifest = self.table.manifest()
        live = [folder for folder, _ in manifest.parts.values()] if manifest else []
        wanted = {f"bucket={b}" for b in map(bucket_of, grams)}
        segments = [s for s, folders in self._segments().covered.items() if set(folders) & set(live)]
        paths = [f"{self.path}/{s}/{b}" for s in segments for b in self._children(s) if b in wanted]
        schema = _LISTS.replace(" bucket int,", "")
        if not paths:
            return self.spark.createDataFrame([], schema)
        names = self.spark.createDataFrame([(f,) for f in live], "folder string")
        found = self.spark.read.schema(schema).parquet(*paths).where(F.col("gram").isin(sorted(grams)))
        return found.join(F.broadcast(names), "folder", "left_semi")

    def candidates(self, patterns: list[str]) -> DataFrame:
        """pattern, folder and id of the rows that hold the rarest trigrams that each pattern needs; for patterns with some."""
        needs = {p: needed_grams(p) for p in patterns}
        every = set().union(*needs.values())
        frequency = {r["gram"]: r["n"] for r in self.lists(every).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # trigrams of the patterns
        asked = []
        for pattern, grams in needs.items():
            if grams and all(g in frequency for g in grams):
                rarest = sorted(grams, key=lambda g: (frequency[g], g))[:RAREST]
                asked += [(pattern, g, len(rarest)) for g in rarest]
        if not asked:
            return self.spark.createDataFrame([], "pattern string, folder string, id string")
        wanted = self.spark.createDataFrame(asked, "pattern string, gram string, needed int")
        ids = self.lists({g for _, g, _ in asked}).join(F.broadcast(wanted), "gram").select("pattern", "needed", "folder", F.explode("ids").alias("id"))
        met = ids.groupBy("pattern", "needed", "folder", "id").agg(F.count(F.lit(1)).alias("n"))
        return met.where(F.col("n") == F.col("needed")).select("pattern", "folder", "id")

    def search_many(self, patterns: list[str]) -> DataFrame:
        """pattern and the table's columns of every row that a pattern matches, in any case of letters."""
        self.refresh()
        manifest = self.table.manifest()
        by_index = [p for p in dict.fromkeys(patterns) if needed_grams(p)]
        rest = [p for p in dict.fromkeys(patterns) if p not in by_index]
        matches = " OR ".join(f"{c} RLIKE concat('(?iu)', pattern)" for c in self.columns)
        out = self.spark.createDataFrame([], self.table._rows(manifest).schema).withColumn("pattern", F.lit("").cast("string"))
        if by_index:
            near = scratch_table(self.candidates(by_index))
            folders = {r[0] for r in near.select("folder").distinct().collect()}  # of the manifest
            rows = self.table._rows(manifest, [p for p, (f, _) in manifest.parts.items() if f in folders])
            ids = near.select("pattern", F.col("id").alias("__id"))
            ids = F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
            out = out.unionByName(rows.join(ids, F.col(self.key) == F.col("__id")).drop("__id").where(matches))
        if rest:
            # A scan, with every pattern tried on each row as it comes by.
            scan = self.table._rows(manifest).withColumn("pattern", F.explode(F.array(*[F.lit(p) for p in rest])))
            out = out.unionByName(scan.where(matches))
        return out

    def search(self, keyword: str, **filters) -> DataFrame:
        """search.filtered over the stored table: the same rows, by the index where the keyword allows it."""
        return filtered(self.search_many([keyword]).drop("pattern"), **filters)
