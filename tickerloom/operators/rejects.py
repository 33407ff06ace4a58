"""One pass that parts rows into those that pass an operator's rules and those it rejects, with the reason and counts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tickerloom.functions.newstext import extract_json, parsed_object
from tickerloom.sources.scratch import shared_folder

REASON = "__reason"
#: Rules by reason, in order: a row is rejected for the first that holds; one that is null does not hold.
Rules = dict[str, Column]


@dataclass
class Routed:
    """passed has the columns of the rows routed; rejected is (operator, reason, key, row), row as JSON; counts is per reason."""

    passed: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def routed(rows: DataFrame, operator: str, rules: Rules, key: list[str]) -> Routed:
    """Evaluates rows and rules once: the rows are written by reason, and each side reads its own folders only."""
    spark = rows.sparkSession
    reason = reduce(lambda rest, rule: F.when(rule[1], F.lit(rule[0])).otherwise(rest), reversed(rules.items()), F.lit(None).cast("string"))
    seen = Observation()
    counted = [F.count_if(F.col(REASON) == r).alias(f"n{i}") for i, r in enumerate(rules)]
    marked = rows.withColumn(REASON, reason).observe(seen, *counted)
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/routed-{uuid.uuid4().hex}"
    marked.write.partitionBy(REASON).parquet(path)
    table = spark.read.schema(StructType([*rows.schema.fields, StructField(REASON, StringType())])).parquet(path)
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    # ignoreNullFields would hide which column was missing.
    row = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    bad = table.where(F.col(REASON).isNotNull()).select(F.lit(operator).alias("operator"), F.col(REASON).alias("reason"), name.alias("key"), row.alias("row"))
    found = seen.get
    return Routed(table.where(F.col(REASON).isNull()).drop(REASON), bad, {r: found[f"n{i}"] for i, r in enumerate(rules)})


def bar_rules() -> Rules:
    """What makes a bar unusable: a missing key or price, or a high or low that contradicts the other prices."""
    prices = ("open", "high", "low", "close")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in prices])
    return {
        "no symbol or date": F.col("symbol").isNull() | (F.trim("symbol") == "") | F.col("trade_date").isNull(),
        "price missing": missing,
        "high below another price": F.col("high") < F.greatest("open", "close", "low"),
        "low above another price": F.col("low") > F.least("open", "close", "high"),
    }


def symbol_rules(symbol: str = "symbol") -> Rules:
    """What keeps a symbol from a market: it is not six digits, or no market begins with its first."""
    s = F.coalesce(F.col(symbol), F.lit(""))
    return {"not six digits": ~s.rlike(r"^\d{6}$"), "no market of this digit": ~F.substring(s, 1, 1).isin(*"01234568", "9")}


def answer_rules(answer: str = "answer") -> Rules:
    """What keeps an answer from being read: it holds no object, or what stands between its braces is no JSON."""
    return {"no object": extract_json(F.col(answer)).isNull(), "not JSON": parsed_object(F.col(answer)).isNull()}
