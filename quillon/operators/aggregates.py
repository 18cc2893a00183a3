"""Aggregates with PostgreSQL's rules: ordered, hypothetical, of ranges, and user-defined."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def array_agg(value, order: Sequence | None = None) -> Column:
    """All values, nulls too, in the order of the given (ascending) keys."""
    value = F.col(value) if isinstance(value, str) else value
    if not order:
        return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda s: s["v"])
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), value.alias("v")))
    return F.transform(F.array_sort(rows), lambda s: s["v"])


def string_agg(value, delimiter: str, order: Sequence | None = None) -> Column:
    """Non-null values joined in order; null if there are none."""
    joined = F.filter(array_agg(value, order), lambda v: v.isNotNull())
    return F.when(F.size(joined) > 0, F.array_join(joined.cast("array<string>"), delimiter))


def hypothetical(value, at) -> dict[str, Column]:
    """Where a row with value ``at`` would rank among the values, for each of the four functions."""
    v, x = F.col(value) if isinstance(value, str) else value, F.lit(at)
    below, n = F.count(F.when(v < x, 1)), F.count(F.lit(1))
    return {
        "rank": below + 1,
        "dense_rank": F.count_distinct(F.when(v < x, v)) + 1,
        "percent_rank": F.when(n > 0, below / n).otherwise(0.0),
        "cume_dist": (F.count(F.when(v <= x, 1)) + 1) / (n + 1),
    }


def mode(value) -> Column:
    """The most frequent value, the smallest of several."""
    name = value if isinstance(value, str) else None
    return F.expr(f"mode() WITHIN GROUP (ORDER BY `{name}`)")


def grouping_sets(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], aggregates: Sequence[Column], distinct: bool = False) -> DataFrame:
    """GROUP BY [DISTINCT] GROUPING SETS; with ``distinct`` equal sets count once."""
    wanted = []
    for s in sets:
        chosen = tuple(k for k in keys if k in set(s))
        if not distinct or chosen not in wanted:
            wanted.append(chosen)
    return df.groupingSets([[F.col(k) for k in s] for s in wanted], *map(F.col, keys)).agg(*aggregates)


def rollup_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(keys[:i]) for i in range(len(keys), -1, -1)]


def cube_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(k for i, k in enumerate(keys) if m >> i & 1) for m in range((1 << len(keys)) - 1, -1, -1)]


def cross_sets(*groups: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """Several grouping elements: each combination of one set of each."""
    made: list[tuple[str, ...]] = [()]
    for g in groups:
        made = [a + tuple(b) for a in made for b in g]
    return made


def user_aggregate(value, initial: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None, order: Sequence | None = None) -> Column:
    """CREATE AGGREGATE with a transition function over values in order.

    The values of a group come together in one task, as the general form needs;
    where a combine function exists, build it from built-in partial aggregates.
    """
    values = array_agg(value, order)
    return F.aggregate(values, initial, step, final) if final else F.aggregate(values, initial, step)


def range_agg(df: DataFrame, keys: Sequence[str], lower: str, upper: str) -> DataFrame:
    """Half-open ranges merged where they touch: gaps and islands by a running maximum."""
    by = Window.partitionBy(*keys).orderBy(lower, upper)
    reach = F.max(upper).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.filter(F.col(lower) < F.col(upper)).withColumn("__fresh", F.coalesce(F.col(lower) > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min(lower).alias(lower), F.max(upper).alias(upper)).drop("__island")


def range_intersect_agg(df: DataFrame, keys: Sequence[str], lower: str, upper: str) -> DataFrame:
    """The common part of all ranges of a key; nulls where it is empty."""
    made = df.groupBy(*keys).agg(F.max(lower).alias("__l"), F.min(upper).alias("__u"))
    some = F.col("__l") < F.col("__u")
    return made.select(*keys, F.when(some, F.col("__l")).alias(lower), F.when(some, F.col("__u")).alias(upper))
