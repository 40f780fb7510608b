"""All core queries by name, collected from the query modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import cohort_queries, orphan_queries, review_queries, search_queries, surface_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (cohort_queries, text_queries, review_queries, search_queries, orphan_queries, surface_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
