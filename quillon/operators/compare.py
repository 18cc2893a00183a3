"""Row-level comparison of two versions of a table, and the plan that makes them equal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTICAL, DIFFERENT, ONLY_SOURCE, ONLY_TARGET = "Identical", "Different", "OnlyInSource", "OnlyInTarget"


def choose_key(primary: Sequence[str] | None, uniques: Sequence[Sequence[str]] = ()) -> list[str] | None:
    """The primary key, else the first unique constraint with columns, else None: not comparable."""
    return list(primary) if primary else next((list(u) for u in uniques if u), None)


def choose_columns(source: DataFrame, target: DataFrame, key: Sequence[str], generated: Sequence[str] = ()) -> list[str]:
    """The columns of both that are neither in the key nor generated."""
    return [c for c in source.columns if c in target.columns and c not in key and c not in generated]


def compare(source: DataFrame, target: DataFrame, key: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """One row for each key: the key, ``category`` and ``diffs`` (column, source, target).

    Values are compared by type, null equal to null. One full join on the keys;
    nothing is collected.
    """
    values = list(values) if values is not None else choose_columns(source, target, key)
    side = lambda df: df.select(F.struct(*key).alias("k"), F.struct(*(F.col(v) for v in values), F.lit(1).alias("__here")).alias("v"))
    s, t = side(source).toDF("sk", "sv"), side(target).toDF("tk", "tv")
    joined = s.join(t, F.col("sk").eqNullSafe(F.col("tk")), "full")
    pick = [F.struct(F.lit(c).alias("column"), F.col(f"sv.{c}").cast("string").alias("source"), F.col(f"tv.{c}").cast("string").alias("target"), (~F.col(f"sv.{c}").eqNullSafe(F.col(f"tv.{c}"))).alias("changed")) for c in values]
    changed = F.filter(F.array(*pick), lambda d: d["changed"]) if pick else F.array().cast("array<struct<column:string,source:string,target:string,changed:boolean>>")
    both = F.col("sv").isNotNull() & F.col("tv").isNotNull()
    category = F.when(F.col("tv").isNull(), ONLY_SOURCE).when(F.col("sv").isNull(), ONLY_TARGET).when(F.size(changed) == 0, IDENTICAL).otherwise(DIFFERENT)
    diffs = F.when(both, F.transform(changed, lambda d: F.struct(d["column"].alias("column"), d["source"].alias("source"), d["target"].alias("target"))))
    return joined.select(*(F.coalesce(F.col(f"sk.{k}"), F.col(f"tk.{k}")).alias(k) for k in key), category.alias("category"), diffs.alias("diffs"))


def summary(compared: DataFrame) -> DataFrame:
    """Rows of each category."""
    return compared.groupBy("category").agg(F.count("*").alias("n"))


def skipped(source_tables: DataFrame, target_tables: DataFrame) -> DataFrame:
    """Tables (table, has_key) that can't be compared, and why."""
    joined = source_tables.select(F.col("table"), F.col("has_key").alias("s")).join(target_tables.select(F.col("table"), F.col("has_key").alias("t")), "table", "full")
    reason = F.when(F.col("t").isNull(), "only in source").when(F.col("s").isNull(), "only in target").when(~(F.col("s") & F.col("t")), "no key")
    return joined.select("table", reason.alias("reason")).filter("reason is not null")


def topological_order(tables: Sequence[str], references: Sequence[tuple[str, str]]) -> list[str]:
    """Parents before children, by name otherwise; cycles are broken where they close.

    ``references`` are (child, parent). Over a catalog, on the driver.
    """
    parents: dict[str, list[str]] = {t: [] for t in tables}
    for child, parent in references:
        if child in parents and parent in parents and child != parent:
            parents[child].append(parent)
    done, order = set(), []
    for root in sorted(tables):
        stack = [(root, iter(sorted(parents[root])))] if root not in done else []
        done.add(root)
        while stack:
            node, rest = stack[-1]
            nxt = next((p for p in rest if p not in done), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                done.add(nxt)
                stack.append((nxt, iter(sorted(parents[nxt]))))
    return order


def sync_plan(compared: Mapping[str, DataFrame], order: Sequence[str], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Actions that turn the targets into the sources, numbered by phase and table.

    Deletes come first, children before parents; then inserts and updates, parents
    first. Each row has ``phase``, ``table_rank``, ``action``, ``table`` and ``key``
    (as JSON); sort by phase, rank and key.
    """
    plan = None
    for rank, name in enumerate(order):
        if name not in compared:
            continue
        action = F.when(F.col("category") == ONLY_TARGET, "delete").when(F.col("category") == ONLY_SOURCE, "insert").when(F.col("category") == DIFFERENT, "update")
        rows = compared[name].withColumn("action", action).filter("action is not null")
        phase = F.when(F.col("action") == "delete", 0).when(F.col("action") == "insert", 1).otherwise(2)
        place = F.when(F.col("action") == "delete", len(order) - 1 - rank).otherwise(rank)
        rows = rows.select(phase.alias("phase"), place.alias("table_rank"), "action", F.lit(name).alias("table"), F.to_json(F.struct(*keys[name])).alias("key"))
        plan = rows if plan is None else plan.unionByName(rows)
    if plan is None:
        raise ValueError("no tables to compare")
    return plan


def literal(column, kind: str):
    """A value as a SQL literal."""
    c = F.col(column)
    if kind in ("string", "date", "timestamp", "timestamp_ntz"):
        c = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def insert_statements(df: DataFrame, name: str) -> DataFrame:
    """An INSERT for each row, with the columns in their order."""
    values = F.concat_ws(", ", *(literal(c, t) for c, t in df.dtypes))
    return df.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("statement"))
