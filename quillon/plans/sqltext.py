"""Queries whose SQL text is the same for Spark and DuckDB, apart from how tables are named."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.base import Plans
from quillon.session import table

_NAME = re.compile(r"\{(\w+)\}")


def run(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    """Spark SQL in which {orders} stands for that table of the folder or a frame in ``more``."""
    frames = {n: table(spark, sf_dir, n) for n in set(_NAME.findall(text)) - set(more)}
    return spark.sql(text, **frames, **more)


def plain(text: str) -> str:
    """The same text with bare table names."""
    return _NAME.sub(r"\1", text)


class SqlPlans(Plans):
    def sql(self, name: str, text: str, duck: str | None = None) -> None:
        """Register a query by its text; ``duck`` is the other engine's where they differ."""

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(spark, sf_dir, text)

        build.__name__ = name
        self.queries[name] = build
        self.oracles[name] = plain(text) if duck is None else duck
