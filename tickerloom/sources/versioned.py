"""Keyed tables stored as versions: a merge rewrites the partitions it touches, and one rename makes it visible.

A table's folder holds data/<merge>/__part=<value>/ with Parquet files and _versions/<number>.json, a manifest that
names, for every partition, the one folder that holds it. A merge writes new folders for the partitions that its rows
touch and a manifest that names the others' folders unchanged; until the manifest is renamed into place, and if it never
is, readers see the version before. A rename onto a number that another writer took first fails, and the merge is done
again on that version. Readers keep to the version they opened; vacuum() removes what no kept version names.

Manifests and listings go through Hadoop's file systems, so a table can lie wherever Spark can read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerloom.operators.store import newest, upsert
from tickerloom.sources.scratch import scratch_table

PART = "__part"
#: What rows without a partition value go to.
NO_PART = "__none__"
RETRIES = 20


class VersionConflict(RuntimeError):
    """Another writer took the version's number."""


@dataclass
class Manifest:
    version: int
    schema: dict
    #: partition value -> [folder under the table's, rows]
    parts: dict[str, list] = field(default_factory=dict)
    #: stream or job -> the last of its batches that is in this version
    applied: dict[str, int] = field(default_factory=dict)
    rewritten: list[str] = field(default_factory=list)


class Journal:
    """Numbered JSON documents in a folder's _versions, each put there by one rename; the files beside them are its table's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def _children(self, *names: str) -> list[str]:
        fs, at = self._fs(), self._at(*names)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _rename(self, source, target) -> None:
        """Moves a file to a name that must be free."""
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, options)

    def _put(self, number: int, document: dict) -> None:
        draft = self._at("_versions", f".{uuid.uuid4().hex}")
        fs = self._fs()
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        try:
            self._rename(draft, self._at("_versions", f"{number:012d}.json"))
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise VersionConflict(f"version {number} of {self.path} is taken") from e
            raise

    def _get(self, number: int) -> dict:
        stream = self._fs().open(self._at("_versions", f"{number:012d}.json"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._children("_versions") if n.endswith(".json") and not n.startswith("."))


class VersionedTable(Journal):
    """A table with one row per keys, partitioned by an SQL expression over its columns.

    keep names columns that stay as they were first stored. moves says that the expression is no function of the keys:
    then a merge also reads the keys and the expression's columns of all stored rows, as a row may come from elsewhere.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partition: str, keep: tuple[str, ...] = (), moves: bool = False):
        super().__init__(spark, path)
        self.keys, self.partition, self.keep, self.moves = keys, partition, keep, moves

    def _commit(self, manifest: Manifest) -> None:
        self._put(manifest.version, manifest.__dict__)

    # -- reading --

    def manifest(self, version: int | None = None) -> Manifest | None:
        """Of a version, by default the newest; None before the first merge."""
        known = self.versions()
        if version is None and not known:
            return None
        if version is not None and version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        return Manifest(**self._get(known[-1] if version is None else version))

    def _rows(self, manifest: Manifest, parts: list[str] | None = None) -> DataFrame:
        chosen = manifest.parts if parts is None else {p: manifest.parts[p] for p in parts if p in manifest.parts}
        schema = StructType.fromJson(manifest.schema)
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder, _ in chosen.values()])

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """Rows of a version (by default the newest), of some partitions or all; later merges do not change what it reads."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows(manifest, parts)

    def has_parts(self, values: list[str], version: int | None = None) -> dict[str, bool]:
        """Which partitions have rows, from the manifest alone."""
        manifest = self.manifest(version)
        return {v: manifest is not None and v in manifest.parts for v in values}

    def history(self) -> DataFrame:
        """version, partitions, rows and rewritten (how many partitions its merge wrote), a row per version."""
        rows = []
        for m in map(self.manifest, self.versions()):
            rows.append((m.version, len(m.parts), sum(n for _, n in m.parts.values()), len(m.rewritten)))
        return self.spark.createDataFrame(rows, "version int, partitions int, rows bigint, rewritten int")

    # -- writing --

    def _partitioned(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, F.coalesce(F.nullif(F.expr(self.partition).cast("string"), F.lit("")), F.lit(NO_PART)))

    def _write(self, rows: DataFrame) -> dict[str, list]:
        """Rows with their partition as new folders: partition -> [folder, rows]. Large partitions get several files."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        names = [n for n in self._children(folder) if n.startswith(f"{PART}=")]
        if not names:
            return {}
        counts = self.spark.read.schema(f"{PART} string").parquet(f"{self.path}/{folder}").groupBy(PART).count()
        rows_of = {r[0]: r[1] for r in counts.collect()}  # a row per partition, as in the manifest
        return {part: [f"{folder}/{n}", rows_of[part]] for n in names for part in [unquote(n.removeprefix(f"{PART}="))]}

    def merge(self, new: DataFrame, by: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Lays new's rows over the table by key and returns the version that holds them.

        by: of rows of new with equal keys the greatest in it counts; without it keys must be unique. batch: (stream,
        number); a batch that is already in is not merged again, so a replay changes nothing.
        """
        if by:
            new = newest(new, self.keys, by)
        staged = scratch_table(self._partitioned(new))
        touched = {r[0] for r in staged.select(PART).distinct().collect()}  # partitions, as in the manifest
        for _ in range(RETRIES):
            base = self.manifest()
            if batch and base and base.applied.get(batch[0], -1) >= batch[1]:
                return base.version
            schema = new.schema if base is None else StructType.fromJson(base.schema)
            old_parts = set(touched)
            if base and self.moves:
                ids = self._partitioned(self._rows(base)).select(*self.keys, PART)
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
                moved = ids.alias("o").join(staged.select(*self.keys).alias("n"), same, "left_semi")
                old_parts |= {r[0] for r in moved.select(PART).distinct().collect()}
            rows = staged.drop(PART).select(schema.names)
            if base:
                rows = upsert(self._rows(base, sorted(old_parts)), rows, self.keys, self.keep)
            written = self._write(self._partitioned(rows))
            kept = {p: x for p, x in base.parts.items() if p not in old_parts} if base else {}
            applied = {**(base.applied if base else {}), **({batch[0]: batch[1]} if batch else {})}
            version = base.version + 1 if base else 0
            try:
                self._commit(Manifest(version, json.loads(schema.json()), {**kept, **written}, applied, sorted(written)))
                return version
            except VersionConflict:
                continue
        raise VersionConflict(f"{self.path} changed {RETRIES} times during a merge")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes manifests before the last keep and the folders that none of those names; returns the folders removed.

        Run it when no merge is under way: a merge's folders are named by no manifest until it commits.
        """
        known = self.versions()
        named = {folder.split("/")[1] for v in known[-keep:] for folder, _ in self.manifest(v).parts.values()}
        gone = [d for d in self._children("data") if d not in named]
        fs = self._fs()
        for v in known[:-keep]:
            fs.delete(self._at("_versions", f"{v:012d}.json"), False)
        for d in gone:
            fs.delete(self._at("data", d), True)
        return gone
