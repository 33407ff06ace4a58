"""Cross-source deduplication of stories that share a dedup key.

greedy() gives the order-dependent result: rows in order of time join the first cluster that shares a key with them, a
row that bridges two clusters does not merge them. It runs as rounds of joins and running minima over all rows at once,
in chunks of arrival. transitive() keeps one row per component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.newstext import dedup_keys, strip
from tickerloom.operators.components import components
from tickerloom.sources.scratch import scratch_table

SOURCE_ORDER = ("cls", "jin10", "10jqka")
#: Most rows of a key that one window takes, and the parts that a cluster's rows are dealt over.
CHUNK, SALTS = 10_000, 16


def with_keys(news: DataFrame) -> DataFrame:
    return dedup_keys(news)


def key_rows(news: DataFrame) -> DataFrame:
    """event_id and key of every key of every row.

    An outer explode: for an inner one the optimizer infers a filter on the list of keys and pushes it below the texts'
    columns, where their expressions are put in for every mention and evaluated again.
    """
    return with_keys(news).select("event_id", F.explode_outer("keys").alias("key")).where(F.col("key").isNotNull())


def preference() -> Column:
    """What makes one row of a cluster the better one."""
    return F.struct(
        F.length(strip(F.col("content"))).alias("content_length"),
        F.size(F.coalesce("subjects", F.array().cast("array<string>"))).alias("n_subjects"),
        (strip(F.col("title")) != "").cast("int").alias("has_title"),
        (F.col("source") == "cls").cast("int").alias("is_first_source"),
        F.col("publish_ts").alias("at"),
    )


def order_of_arrival() -> Column:
    source = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source")), F.lit(0))
    return F.struct(F.col("publish_ts").alias("ts"), source.alias("source_place"), F.col("event_id").alias("id"))


def key_components(keyed: DataFrame, scratch=None) -> DataFrame:
    """event_id and component (its least event_id) of every row with keys."""
    scratch = scratch or scratch_table
    return linked(scratch(keyed.select("event_id", F.explode("keys").alias("key")).select("event_id", F.unhex(F.md5("key")).alias("key"))), scratch)


def _roots(edges: DataFrame, scratch) -> DataFrame:
    """event_id and root (the least number of a key) of every row of edges (event_id, key digest) with a key of several rows.

    Shared keys are numbered. Only rows with several of them link anything, each its least key to its others; the graph
    has keys as nodes and every such pair once, however many rows name it.
    """
    counts = edges.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A key of one row links nothing, and most keys are such.
    numbered = scratch(counts.where("n > 1").select("key", F.monotonically_increasing_id().alias("k")))
    marked = scratch(edges.join(numbered, "key").select("event_id", "k"))
    rows = scratch(marked.groupBy("event_id").agg(F.min("k").alias("first"), F.max("k").alias("last")))
    several = rows.where("last > first").select("event_id", "first")
    links = marked.join(several, "event_id").where("k > first").select(F.col("k").alias("a"), F.col("first").alias("b")).distinct()
    roots = components(scratch(links), scratch=scratch).select(F.col("node").alias("first"), "root")
    return rows.drop("last").join(roots, "first", "left").select("event_id", F.coalesce("root", "first").alias("root"))


def linked(edges: DataFrame, scratch) -> DataFrame:
    """event_id and component (its least event_id) of the rows of edges (event_id, key digest)."""
    rows = scratch(_roots(edges, scratch))
    names = rows.groupBy("root").agg(F.min("event_id").alias("component"))
    alone = edges.select("event_id").distinct().join(rows, "event_id", "left_anti").withColumn("component", F.col("event_id"))
    return rows.join(names, "root").select("event_id", "component").unionByName(alone)


def _last_first(value: Column) -> Column:
    """value so that ascending order puts the greatest first and nulls last."""
    return F.coalesce(-value.cast("bigint"), F.lit(2**63 - 1))


def transitive(news: DataFrame, scratch=None) -> DataFrame:
    """The preferred row of every component, and every row without keys."""
    scratch = scratch or scratch_table
    digests = F.transform("keys", lambda k: F.unhex(F.md5(k)))
    # Keys and preferences are worked out once; only short columns go on.
    keyed = scratch(with_keys(news).select("event_id", digests.alias("keys"), preference().alias("preference"), order_of_arrival().alias("arrival")))
    roots = scratch(_roots(keyed.select("event_id", F.explode("keys").alias("key")), scratch))
    # Ties keep the row that arrived first. A component is folded in parts, so it may be as large as the table.
    fields = ("content_length", "n_subjects", "has_title", "is_first_source", "at")
    rank = F.struct(*[_last_first(F.col("preference")[f]) for f in fields], "arrival")
    ranked = keyed.select("event_id", rank.alias("rank")).join(roots, "event_id")
    best = ranked.groupBy("root").agg(F.min("event_id").alias("component"), F.min_by("event_id", "rank").alias("event_id")).drop("root")
    grouped = roots.select("event_id", F.lit(True).alias("grouped"))
    kept = news.join(grouped, "event_id", "left").join(best, "event_id", "left").where("grouped IS NULL OR component IS NOT NULL").drop("grouped")
    return kept.withColumn("component", F.coalesce("component", "event_id"))


def _placed(news: DataFrame, scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with keys (place, event_id, preference) and their shared keys (place, chunk, key).

    place numbers rows in order of arrival, chunk is a range of at most CHUNK places. Keys are 128-bit digests, and only
    those of several rows are kept.
    """
    digests = F.transform("keys", lambda k: F.unhex(F.md5(k)))
    # Written before they are filtered and sorted, either of which would evaluate the texts' expressions again.
    keyed = scratch(with_keys(news).select(order_of_arrival().alias("arrival"), "event_id", preference().alias("preference"), digests.alias("keys")))
    rows = keyed.where(F.size("keys") > 0).orderBy("arrival").withColumn("place", F.monotonically_increasing_id()).drop("arrival")
    rows = scratch(rows)
    edges = scratch(rows.select("place", F.floor(F.col("place") / CHUNK).alias("chunk"), F.explode("keys").alias("key")))
    parts = edges.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("c"))
    shared = parts.withColumn("c", F.sum("c").over(Window.partitionBy("key"))).where("c > 1").select("key", "chunk")
    return rows.drop("keys"), scratch(edges.join(shared, ["key", "chunk"], "left_semi"))


def _found_homes(at: DataFrame) -> DataFrame:
    """place and the least of its home and, over its keys, the homes of earlier rows with that key; at: place, chunk, key, home.

    A running minimum runs within (key, chunk), what earlier chunks end with is carried over as a row per chunk.
    """
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    within = at.withColumn("within", F.min("home").over(earlier("key", "chunk").orderBy("place")))
    ends = at.groupBy("key", "chunk").agg(F.min("home").alias("end"))
    carried = ends.select("key", "chunk", F.min("end").over(earlier("key").orderBy("chunk")).alias("carried"))
    return within.join(carried, ["key", "chunk"]).groupBy("place").agg(F.min(F.least("home", "within", "carried")).alias("home"))


def _next_homes(edges: DataFrame, homes: DataFrame) -> DataFrame:
    return _found_homes(edges.join(homes, "place"))


def _jumped(homes: DataFrame) -> DataFrame:
    """Homes replaced by their own homes, which halves the way along a chain; a home's rows are dealt over SALTS."""
    ends = homes.select(F.col("place").alias("home"), F.col("home").alias("further")).where("further < home")
    used = homes.where("home < place").select("home").distinct()
    ends = ends.join(used, "home").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = homes.withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int"))
    return dealt.join(ends, ["home", "salt"], "left").select("place", F.coalesce("further", "home").alias("home"))


def _core(edges: DataFrame) -> DataFrame:
    """place of the rows that can change what later rows find: those with several shared keys, and every key's first row.

    Any other row has one key, takes the least home that its key has by then, and leaves it as it is.
    """
    firsts = edges.groupBy("key").agg(F.min("place").alias("place")).select("place")
    several = edges.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place")
    return firsts.union(several).distinct()


def _settled(edges: DataFrame, scratch) -> DataFrame:
    """Homes of all rows of edges, by rounds that end when no home changes."""
    homes = scratch(edges.select("place").distinct().withColumn("home", F.col("place")))
    total = F.sum(F.col("home").cast("decimal(38,0)"))
    last = homes.agg(total).first()[0]
    while True:
        homes = scratch(_jumped(scratch(_next_homes(edges, homes))))
        now = homes.agg(total).first()[0]
        if now == last:  # homes only ever fall
            return homes
        last = now


def greedy_homes(edges: DataFrame, scratch=None) -> DataFrame:
    """place and home (the place that founded its cluster) of every row with shared keys.

    A row's home is the least one that its keys' earlier rows have, else itself. Rounds over the core's rows start with
    every row its own home and end when no home changes, so their number has no bound but the longest chain's. One more
    pass gives all other rows the homes that they find.
    """
    scratch = scratch or scratch_table
    core = scratch(_core(edges))
    settled = _settled(scratch(edges.join(core, "place", "left_semi")), scratch)
    rest = edges.join(core, "place", "left_anti")
    asked = rest.select("place", "chunk", "key", F.lit(None).cast("bigint").alias("home"))
    at = edges.join(settled, "place").select("place", "chunk", "key", "home").unionByName(asked)
    return settled.select("place", "home").unionByName(_found_homes(at).join(core, "place", "left_anti"))


def greedy(news: DataFrame, scratch=None) -> DataFrame:
    """Rows that survive the greedy pass, in the shape of news; no group of rows is whole in one task."""
    scratch = scratch or scratch_table
    rows, edges = _placed(news, scratch)
    # Of equally good rows the one that arrived first stays.
    ranked = rows.join(greedy_homes(edges, scratch), "place").select("event_id", "home", F.struct("preference", -F.col("place")).alias("rank"))
    ranked = scratch(ranked)
    kept = ranked.groupBy("home").agg(F.max_by("event_id", "rank").alias("event_id")).select("event_id")
    lost = ranked.select("event_id").join(kept, "event_id", "left_anti")
    return news.join(lost, "event_id", "left_anti")


def shared_key_pairs(news: DataFrame) -> DataFrame:
    """key, n_rows and first_id of every dedup key that several rows share."""
    edges = key_rows(news)
    return edges.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_id")).where("n_rows > 1")
