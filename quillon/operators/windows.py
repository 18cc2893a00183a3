"""Windows and row limits that Spark has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNBOUNDED = None


def _named(cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def distinct_on(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*_named(keys)).orderBy(*_named(order))
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def top_k(df: DataFrame, keys: Sequence, order: Sequence, k: int) -> DataFrame:
    """At most k rows of each key; Catalyst limits each partition before the exchange."""
    w = Window.partitionBy(*_named(keys)).orderBy(*_named(order))
    return df.withColumn("__nth", F.row_number().over(w)).filter(F.col("__nth") <= k).drop("__nth")


def with_ties(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first n rows and those that tie with the last of them.

    The n-th row is found by a distributed top-k; a window over all rows in one
    task isn't needed. ``order`` are columns with a direction.
    """
    if n <= 0:
        return df.limit(0)
    columns = _named(order)
    top = df.orderBy(*columns).limit(n)
    values = [f"__o{i}" for i in range(len(columns))]
    plain = [_bare(c) for c in columns]
    ties = top.select(*(p.alias(v) for p, v in zip(plain, values, strict=True))).withColumn("__at", F.row_number().over(Window.orderBy(*(_directed(c, v) for c, v in zip(columns, values, strict=True)))))
    last = ties.orderBy(F.col("__at").desc()).limit(1).drop("__at")
    before = None
    equal = F.lit(True)
    for c, p, v in zip(columns, plain, values, strict=True):
        less = _precedes(c, p, F.col(v))
        before = (equal & less) if before is None else before | (equal & less)
        equal = equal & p.eqNullSafe(F.col(v))
    return df.join(F.broadcast(last), before | equal).select(*df.columns)  # one row is broadcast


def _text(c: Column) -> str:
    return c._jc.toString() if hasattr(c, "_jc") else str(c)


def _bare(c: Column) -> Column:
    text = _text(c)
    for end in (" ASC NULLS FIRST", " ASC NULLS LAST", " DESC NULLS FIRST", " DESC NULLS LAST"):
        if text.endswith(end):
            return F.expr(text[: -len(end)])
    return c


def _directed(c: Column, name: str) -> Column:
    text = _text(c)
    kind = ("desc" if " DESC " in text else "asc") + ("_nulls_first" if text.endswith("NULLS FIRST") else "_nulls_last")
    return getattr(F.col(name), kind)()


def _precedes(c: Column, a: Column, b: Column) -> Column:
    text = _text(c)
    less = a > b if " DESC " in text else a < b
    first = a.isNull() & b.isNotNull() if text.endswith("NULLS FIRST") else a.isNotNull() & b.isNull()
    return F.coalesce(less, F.lit(False)) | first


def groups_frame(df: DataFrame, keys: Sequence, order: str, start: int | None, end: int | None, aggregates: dict, descending: bool = False) -> DataFrame:
    """Aggregates over GROUPS BETWEEN start AND end (peer groups; None is unbounded).

    ``aggregates`` maps a name to a function of a window that gives a column.
    """
    o = F.col(order).desc_nulls_first() if descending else F.col(order).asc_nulls_last()
    df = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*_named(keys)).orderBy(o)))
    w = Window.partitionBy(*_named(keys)).orderBy("__peer").rangeBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)
    return df.withColumns({name: of(w) for name, of in aggregates.items()}).drop("__peer")


def sum_excluding(df: DataFrame, keys: Sequence, order: Sequence, value: str, frame: tuple[int | None, int | None], exclude: str, name: str) -> DataFrame:
    """sum(value) over a ROWS frame without the current row, its group or its ties.

    Only sums are taken, so each row costs the same however wide the frame is:
    what is left out is itself a sum over rows of the frame with the same order
    key. With the current group, the frame's part of it is found by row numbers.
    """
    plain = Window.partitionBy(*_named(keys)).orderBy(*_named(order))
    low = Window.unboundedPreceding if frame[0] is None else frame[0]
    high = Window.unboundedFollowing if frame[1] is None else frame[1]
    framed = plain.rowsBetween(low, high)
    held = F.col(value)
    total, n = F.sum(held).over(framed), F.count(held).over(framed)
    inside = (frame[0] is None or frame[0] <= 0) and (frame[1] is None or frame[1] >= 0)
    if exclude == "current row":
        out, out_n = (F.coalesce(held, F.lit(0)), held.isNotNull().cast("int")) if inside else (F.lit(0), F.lit(0))
        return df.withColumn(name, F.when(n - out_n > 0, total - out))
    df = df.withColumns({"__rn": F.row_number().over(plain), "__peer": F.dense_rank().over(plain), "__total": total, "__n": n})
    peers = Window.partitionBy(*_named(keys), "__peer").orderBy("__rn").rowsBetween(low, high)
    df = df.withColumns({"__out": F.coalesce(F.sum(held).over(peers), F.lit(0)), "__out_n": F.count(held).over(peers)})
    if exclude == "ties" and inside:
        df = df.withColumns({"__out": F.col("__out") - F.coalesce(held, F.lit(0)), "__out_n": F.col("__out_n") - held.isNotNull().cast("int")})
    made = df.withColumn(name, F.when(F.col("__n") - F.col("__out_n") > 0, F.col("__total") - F.col("__out")))
    return made.drop("__rn", "__peer", "__total", "__n", "__out", "__out_n")


def filter_over(function, value: Column, condition: Column, window) -> Column:
    """agg(value) FILTER (WHERE condition) OVER window."""
    return function(F.when(condition, value)).over(window)
