"""Names of the registered queries and of their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerloom.plans import bar_queries, claim_queries, landing_queries, news_queries, payload_queries, sector_queries, store_queries, stream_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (sector_queries, news_queries, bar_queries, claim_queries, landing_queries, payload_queries, store_queries, stream_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
