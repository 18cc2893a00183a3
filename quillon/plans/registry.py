"""All registered queries with their DuckDB counterparts, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import builtins, changes, combining, filters, grouping, joining, jsons, metadata, ordering, projects, relational, scalars, scans, storage, streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

for module in (relational, scans, filters, joining, grouping, ordering, combining, scalars, builtins, jsons, changes, metadata, projects, storage, streams):
    if again := QUERIES.keys() & module.QUERIES.keys():
        raise ValueError(f"queries registered twice: {sorted(again)}")
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
