"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's documents all get the same expected number of copies, target / source size, at most MAX_COPIES. The whole
part is certain. The fractional part p is rounded by dependent pairs: of two documents with fractional p, word mass
moves from one to the other until one of them is 0 or 1, in the direction drawn so that each p keeps its expectation
and p * size keeps its sum. A source's heavy documents (fewer than HEAVY) are rounded first, the last of them by a draw
whose gain or loss is spread over the light documents' p; the last light one goes to the nearer whole number. So a
source's taken words differ from the target by at most half a light document, unless the light ones can't make up for
a heavy one.

The reduction tree: light documents of a source fall by hash into chunks of about CHUNK rows, each chunk is folded from the
largest document to the smallest and leaves at most one fractional document; these residuals are the next level's
rows, until one is left in a source. Chunks are bounded however large a source is.

All draws are hashes of doc_id, repeat number, size and SEED: reruns agree on any cluster.

Null text, and text without words, has size 0 and takes 0. A null source is a source of its own, the last in order.
Rows repeating doc_id, source and size are separate rows, numbered from 1. A source whose size is 0 has target 0. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import fresh, unit, word_count, written

#: Sources' weights in order of name, repeating.
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
CHUNK = 256
#: A document of more than 1 / HEAVY of its source's words is heavy; a source has fewer than HEAVY of them.
HEAVY = 64
SEED = 20240131


def sized(docs: DataFrame) -> DataFrame:
    """source, doc_id, size and n: how many rows of docs these three stand for."""
    return docs.select("source", "doc_id", word_count(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))


def _in_order(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """rows sorted over all partitions and written, with part, the place of a row's partition in that order."""
    return written(rows.orderBy(*order).withColumn("part", F.spark_partition_id()), label)


def _sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """_in_order()'s rows with the sums over all rows before each: within its part by a window, before it by the parts'
    totals. No window sees more than a part of the rows or a row per part."""
    totals = rows.groupBy("part").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the sort has partitions
    offsets = totals.select("part", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_offset") for name in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), "part")
    return out.withColumns({name: F.col(f"{name}_offset") + F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}).drop("part", *[f"{name}_offset" for name in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """A row per source: source, source_size, target, source_rows.

    Targets are the level L at which min(cap, L * weight) sums to all words. With sources in order of cap / weight,
    the level that holds if the first k are at their caps rises until the right k and falls after it, so L is the
    largest of them. Sources are ranked and summed in order over all partitions, however many there are.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("source_rows"))
    by_name = [F.col("source").asc_nulls_last()]
    per = _sums_before(_in_order(per, by_name, "mix-names"), by_name, {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(max_copies)) * F.col("source_size")).drop("place")
    by_ratio = [F.col("cap") / F.col("weight"), *by_name]
    per = written(_sums_before(_in_order(per, by_ratio, "mix-ratios"), by_ratio, {"caps": F.col("cap"), "weights": F.col("weight")}), "mix-sources")
    whole = per.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weights"))
    level = per.join(F.broadcast(whole)).agg(F.max((F.col("all_words") - F.col("caps")) / (F.col("all_weights") - F.col("weights"))).alias("level"))
    return per.join(F.broadcast(level)).select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"), "source_rows")


def _meet(acc: Column, x: Column) -> Column:
    """One step of the fold over fractional rows (neg_size, mark, doc_id, nth, size, p) to struct(carry, done).

    done: rows whose p is 0 or 1; carry: the one that stays fractional, or null.
    """
    c = acc["carry"]
    up_c, up_x = (1 - c["p"]) * c["size"], x["p"] * x["size"]  # room in c, mass in x
    down_c, down_x = c["p"] * c["size"], (1 - x["p"]) * x["size"]
    up, down = F.least(up_c, up_x), F.least(down_c, down_x)
    rises = unit(c["mark"], x["mark"], F.lit(SEED)) * (up + down) < down
    new_c = F.when(rises, F.when(up_c <= up_x, F.lit(1.0)).otherwise(c["p"] + up / c["size"])).otherwise(F.when(down_c <= down_x, F.lit(0.0)).otherwise(c["p"] - down / c["size"]))
    new_x = F.when(rises, F.when(up_x <= up_c, F.lit(0.0)).otherwise(x["p"] - up / x["size"])).otherwise(F.when(down_x <= down_c, F.lit(1.0)).otherwise(x["p"] + down / x["size"]))
    whole_c = F.when(rises, up_c <= up_x).otherwise(down_c <= down_x)
    whole_x = F.when(rises, up_x <= up_c).otherwise(down_x <= down_c)
    c2, x2 = c.withField("p", new_c), x.withField("p", new_x)
    carry = F.when(c.isNull(), x).when(~whole_c, c2).when(~whole_x, x2)
    settled = F.array_compact(F.array(F.when(whole_c, c2), F.when(whole_x, x2)))
    return F.struct(carry.alias("carry"), F.when(c.isNull(), acc["done"]).otherwise(F.concat(acc["done"], settled)).alias("done"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, chunk: int = CHUNK) -> DataFrame:
    """A row per row of docs: source, doc_id, nth (among rows equal in these and size), size, source_size, target, copies."""
    sizes = written(sized(docs), "mix-sizes")
    targets = source_targets(sizes, weights, max_copies)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # eqNullSafe keeps the null source; one row per source on the right, so adaptive execution may broadcast it by its size.
    named = targets.withColumnRenamed("source", "of_source")
    rows = (
        sizes.join(named, F.col("source").eqNullSafe(F.col("of_source")))
        .drop("of_source")
        .withColumn("share", share)
        .withColumn("base", F.floor("share"))
        .withColumn("p", F.col("share") - F.col("base"))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    )
    fixed = (F.col("p") <= 0) | (F.col("size") == 0)
    certain = rows.where(fixed).select("source", "doc_id", "nth", "size", "source_size", "target", F.col("base").alias("copies"))
    facts = ["source", "source_size", "target", "base"]
    item = F.struct((-F.col("size")).alias("neg_size"), F.xxhash64("doc_id", "nth", "size", F.lit(SEED)).alias("mark"), "doc_id", "nth", "size", "p").alias("item")
    loose = rows.where(~fixed).select(*facts, F.col("source_rows").alias("left"), (F.col("size") * HEAVY > F.col("source_size")).alias("heavy"), item)

    folded = written(_folded(loose.where("heavy"), facts), "mix-heavy")
    settled = certain.unionByName(_as_rows(folded.select(*facts, F.explode("done").alias("item")), F.col("item.p").cast("long")))
    last = folded.where(F.col("carry").isNotNull()).select(*facts, F.col("carry").alias("item"))
    drawn = (unit(F.col("item.mark"), F.lit(SEED + 1)) < F.col("item.p")).cast("long")
    settled = settled.unionByName(_as_rows(last, drawn))

    # What the heavy documents' draw gave or took is spread over the light documents' p, whose words are light_size.
    heavy = loose.where("heavy").groupBy("source").agg(F.sum("item.size").alias("heavy_size"))
    owed = last.select("source", (F.col("item.size") * (drawn - F.col("item.p"))).alias("owed"))
    owed = owed.join(heavy.withColumnRenamed("source", "h_source"), F.col("source").eqNullSafe(F.col("h_source"))).select(F.col("source").alias("o_source"), "owed", "heavy_size")
    light = loose.where(~F.col("heavy")).join(owed, F.col("source").eqNullSafe(F.col("o_source")), "left")
    shift = F.coalesce(F.col("owed") / (F.col("source_size") - F.col("heavy_size")), F.lit(0.0))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("item.p") - shift))
    level = light.select(*facts, "left", F.col("item").withField("p", moved).alias("item"))

    most = sizes.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = 0
    while True:
        depth += 1
        most = -(-most // chunk)
        chunks = F.ceil(F.col("left") / F.lit(chunk))
        part = F.pmod(F.xxhash64(F.col("item.mark"), F.lit(depth)), chunks)
        folded = written(_folded(level.withColumns({"left": chunks, "part": part}), [*facts, "left", "part"]).drop("part"), f"mix-level{depth}")
        settled = settled.unionByName(_as_rows(folded.select(*facts, F.explode("done").alias("item")), F.col("item.p").cast("long")))
        level = folded.where(F.col("carry").isNotNull()).select(*facts, "left", F.col("carry").alias("item"))
        if most <= 1:
            break
    return settled.unionByName(_as_rows(level, (F.col("item.p") >= 0.5).cast("long")))


def _folded(level: DataFrame, by: list[str]) -> DataFrame:
    """by, carry and done: the fold of each group's items, from the largest document to the smallest."""
    grouped = level.groupBy(*by).agg(F.array_sort(F.collect_list("item")).alias("items"))
    kind = grouped.schema["items"].dataType
    start = F.struct(F.lit(None).cast(kind.elementType).alias("carry"), F.array().cast(kind).alias("done"))
    return grouped.select(*by, F.aggregate("items", start, _meet).alias("out")).select(*by, "out.carry", "out.done")


def _as_rows(df: DataFrame, extra: Column) -> DataFrame:
    return df.select("source", "item.doc_id", "item.nth", "item.size", "source_size", "target", (F.col("base") + extra).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; docs' own columns."""
    plan = copies(docs, **how)
    size, nth, times = (fresh(docs, c) for c in ("mix_size", "mix_nth", "mix_copies"))
    own = docs.withColumn(size, word_count(F.col("text")))
    # Rows equal in source, doc_id and size are interchangeable to the plan; numbering them needs no order between them.
    place = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
    own = own.withColumn(nth, F.row_number().over(place).cast("long"))
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("nth").alias("p_nth"), F.col("copies").alias(times)).where(F.col(times) > 0)
    on = own["doc_id"].eqNullSafe(plan["p_id"]) & own["source"].eqNullSafe(plan["p_source"]) & (own[size] == plan["p_size"]) & (own[nth] == plan["p_nth"])
    joined = own.join(plan, on)
    out = joined.select(*[own[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(fresh(docs, "mix_time")))
    return out.select(*docs.columns)
