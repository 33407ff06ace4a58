"""Deep pages against a plain sort: crowded seconds, null times, pages over the end."""

import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators.deep_pages import deep_page
from tickerloom.operators.search import page


@pytest.fixture(scope="module")
def listing(spark):
    rng = random.Random(5)
    rows = [(f"{rng.choice(['a', 'ab', 'b', 'é', ''])}{i}", rng.choice([1_700_000_000, 1_700_000_000, 1_700_000_001, rng.randrange(1_690_000_000, 1_700_000_000), None, -5])) for i in range(3000)]
    return spark.createDataFrame(rows, "event_id string, publish_ts bigint").repartition(6).cache()


@pytest.mark.parametrize("skip", [0, 3, 700, 1490, 1500, 1999, 2600, 2990, 5000, -4])
def test_pages_equal_a_sort(listing, skip):
    want = [tuple(r) for r in page(listing, skip, 40).collect()]
    assert [tuple(r) for r in deep_page(listing, skip, 40, small=25).collect()] == want
    assert [tuple(r) for r in deep_page(listing, skip, 40).collect()] == want


def test_rows_sorted_in_one_place_are_bounded(spark):
    """Skipping fifty thousand rows, of which forty thousand share a second, sorts a few hundred."""
    rows = spark.range(120_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("event_id"), F.when(F.col("id") < 40_000, 1_700_000_000).otherwise(1_600_000_000 + F.col("id") * 7).cast("bigint").alias("publish_ts"))
    for skip in (30_000, 50_000):
        got = deep_page(rows, skip, 50, small=500)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in page(rows, skip, 50).collect()]
        plan = got._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "Sort":
            plan = plan.children().head()
        inner = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.child())
        assert inner.count() <= 550
