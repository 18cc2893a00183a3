"""Metadata of tables as tables, read from their schemas alone; and declared keys put to the test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "schema string, table string, name string, ordinal int, type string, nullable boolean, default string, generated string, identity string"


def columns(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "main") -> DataFrame:
    """One row for each column of each table; no data is read."""
    rows = [(schema, t, f.name, i, f.dataType.simpleString(), f.nullable, None, None, None) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, COLUMNS)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary key: rows of keys that repeat or hold a null, with how often."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = None
    for k in keys:
        missing = F.col(k).isNull() if missing is None else missing | F.col(k).isNull()
    return counted.filter((F.col("n") > 1) | missing)


def unique_violations(df: DataFrame, keys: Sequence[str], nulls_distinct: bool = True) -> DataFrame:
    """Unique constraint: keys that repeat; rows with a null count only where nulls aren't distinct."""
    rows = df.dropna(subset=list(keys)) if nulls_distinct else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_violations(df: DataFrame, expression: str) -> DataFrame:
    """Check constraint: rows for which it is false; an unknown result passes."""
    return df.filter(f"not ({expression})")


def reference_violations(child: DataFrame, parent: DataFrame, keys: Sequence[tuple[str, str]], full: bool = False) -> DataFrame:
    """Foreign key: child rows without a parent. Any null passes; with MATCH FULL all or none must be null."""
    some = [F.col(c).isNull() for c, _ in keys]
    anyone, all_of = some[0], some[0]
    for s in some[1:]:
        anyone, all_of = anyone | s, all_of & s
    parents = parent.select(*(F.col(p).alias(f"__p{i}") for i, (_, p) in enumerate(keys))).distinct()
    lost = child.filter(~anyone).join(parents, [F.col(c) == F.col(f"__p{i}") for i, (c, _) in enumerate(keys)], "left_anti")
    return lost.unionByName(child.filter(anyone & ~all_of)) if full else lost
