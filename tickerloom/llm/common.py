"""What the operators share: the shared scratch folder, column expressions, safe column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.sources.scratch import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word pattern: space and the five control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, so lost executors cost no recomputation.

    A Parquet table rather than checkpoint(): it is compressed and readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null counts as no text."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")
    trimmed = F.trim(kept)
    gaps = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed == "", F.lit(0).cast("long")).otherwise((gaps + 1).cast("long"))


def unit(*parts: Column) -> Column:
    """A reproducible uniform number in [0, 1) from the hash of parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Rows of a few numbers that may be broadcast after counting them; more than that joins by shuffle.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; df should be narrow and cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
