"""Changes of tables as functions that return the new table.

Parquet has no rows that can be changed in place; each operation takes the table
as it is and gives the table as it would be. Matching keys must be unique in the
source; where they aren't, the row that comes first by the source's columns is
used, so that the result is deterministic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _once(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*source.columns)
    return source.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def _sides(target: DataFrame, source: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Both rows as structs t and s, joined by the keys."""
    t = target.select(F.struct(*target.columns).alias("t"))
    s = source.select(F.struct(*source.columns).alias("s"))
    return t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], how)


def insert(target: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows added; columns that they lack get their default or null."""
    filled = [F.col(c) if c in rows.columns else ((defaults or {}).get(c, F.lit(None)).cast(target.schema[c].dataType).alias(c)) for c in target.columns]
    return target.unionByName(rows.select(*filled))


def insert_or_nothing(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    fresh = _once(rows, keys).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], assign: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE SET assign WHERE where; columns as t.x (old) and s.x (excluded)."""
    both = _sides(target, _once(rows, keys), keys, "full")
    assign = assign if assign is not None else {c: F.col(f"s.{c}") for c in target.columns if c not in keys}
    matched = F.col("t").isNotNull() & F.col("s").isNotNull()
    change = matched if where is None else matched & F.coalesce(where, F.lit(False))
    return both.select(*(F.when(F.col("t").isNull(), F.col(f"s.{c}")).when(change, assign.get(c, F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], assign: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... SET assign FROM source WHERE keys match and ``where`` holds."""
    both = _sides(target, _once(source, keys), keys, "left")
    hit = F.col("s").isNotNull() if where is None else F.col("s").isNotNull() & F.coalesce(where, F.lit(False))
    return both.select(*(F.when(hit, assign[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in assign else F.col(f"t.{c}").alias(c) for c in target.columns))


def delete_using(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DELETE ... USING: rows with a match go."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns)


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


@dataclass
class When:
    """A WHEN clause: matched, missing (NOT MATCHED) or orphan (NOT MATCHED BY SOURCE)."""

    on: str
    action: str  # update, delete, insert or nothing
    condition: Column | None = None
    values: Mapping[str, Column] = field(default_factory=dict)


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[When]) -> tuple[DataFrame, DataFrame]:
    """MERGE: the new table, and RETURNING rows (action, old, new) of what changed.

    The first clause whose kind and condition fit a row decides it. One full join,
    whatever the number of clauses.
    """
    both = _sides(target, _once(source, keys), keys, "full")
    kind = {"matched": F.col("t").isNotNull() & F.col("s").isNotNull(), "missing": F.col("t").isNull(), "orphan": F.col("s").isNull()}
    choice = None
    for i, c in enumerate(clauses):
        fits = kind[c.on] & F.coalesce(c.condition, F.lit(False)) if c.condition is not None else kind[c.on]
        choice = F.when(fits, i) if choice is None else choice.when(fits, i)
    both = both.withColumn("__clause", F.coalesce(choice, F.lit(-1)) if choice is not None else F.lit(-1))
    columns = []
    for c in target.columns:
        value = None
        for i, w in enumerate(clauses):
            if w.action in ("update", "insert"):
                old = F.col(f"t.{c}") if w.action == "update" else F.lit(None)
                made = w.values.get(c, old) if w.values else F.col(f"s.{c}")
                value = F.when(F.col("__clause") == i, made) if value is None else value.when(F.col("__clause") == i, made)
        columns.append((F.col(f"t.{c}") if value is None else value.otherwise(F.col(f"t.{c}"))).alias(c))
    action = F.array(*(F.lit(w.action) for w in clauses), F.lit("nothing"))
    both = both.withColumn("__action", F.element_at(action, F.when(F.col("__clause") < 0, len(clauses) + 1).otherwise(F.col("__clause") + 1)))
    stays = (F.col("__action") != "delete") & (F.col("t").isNotNull() | (F.col("__action") == "insert"))
    table = both.filter(stays).select(*columns)
    changed = both.filter(F.col("__action").isin("update", "delete", "insert") & (F.col("t").isNotNull() | (F.col("__action") == "insert")))
    returning = changed.select(F.col("__action").alias("action"), F.col("t").alias("old"), F.when(F.col("__action") != "delete", F.struct(*columns)).alias("new"))
    return table, returning
