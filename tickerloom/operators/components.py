"""Connected components of a link table, by alternating large-star and small-star steps over joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.sources.scratch import scratch_table


def _large_star(edges: DataFrame, scratch) -> DataFrame:
    """Every node's larger neighbours are linked to the least of the node and its neighbours.

    least is written before it is joined: both sides of that join then come straight from exchanges or files, which is
    what adaptive execution needs to split the rows of a node with very many neighbours.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, scratch) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them; edges run from a down to b."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b"))
    least = scratch(down.groupBy("a").agg(F.min("b").alias("m")))
    across = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 50, scratch=None) -> DataFrame:
    """node and root (the least node reachable) of every node of edges (a, b) other than the roots themselves.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path. Where most_rounds do
    not suffice this is an error, never a result.
    """
    scratch = scratch or scratch_table
    state = (-1, 0)
    for _ in range(most_rounds):
        edges = scratch(_small_star(scratch(_large_star(edges, scratch)), scratch))
        row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if (row[0], row[1]) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (row[0], row[1])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
