"""Set-returning functions: series, subscripts, unnest, ordinality and ROWS FROM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def series(start, stop, step=1) -> Column:
    """generate_series over integers as an array; empty where the step leads away from the end."""
    a, b, s = (_c(x).cast("bigint") for x in (start, stop, step))
    leads = ((s > 0) & (a <= b)) | ((s < 0) & (a >= b))
    wrong = F.raise_error(F.lit("step size cannot equal zero")).cast("array<bigint>")
    return F.when(s == 0, wrong).when(leads, F.sequence(a, b, s)).when(a.isNotNull() & b.isNotNull(), F.array().cast("array<bigint>"))


def decimal_series(start: str, stop: str, step: str, digits: int) -> Column:
    """The same over decimals with so many digits, counted in whole steps of the last digit."""
    scale = 10**digits
    whole = lambda x: F.round(F.lit(x).cast(f"decimal(30,{digits})") * scale).cast("bigint")
    return F.transform(series(whole(start), whole(stop), whole(step)), lambda v: (v / F.lit(scale)).cast(f"decimal(30,{digits})"))


def time_series(start, stop, step: str) -> Column:
    """The same over timestamps with an interval such as '1 day'."""
    a, b = _c(start), _c(stop)
    return F.when(a <= b, F.sequence(a, b, F.expr(f"interval {step}")))


def subscripts(values, reverse: bool = False) -> Column:
    """generate_subscripts of the first dimension."""
    n = F.size(_c(values)).cast("bigint")
    return series(n, 1, -1) if reverse else series(1, n)


def unnest(df: DataFrame, arrays: dict[str, Column], keep: Sequence[str] = (), ordinality: str | None = None) -> DataFrame:
    """unnest of one array or several side by side, shorter ones padded with nulls; ROWS FROM is the same.

    ``ordinality`` names a column that counts from 1.
    """
    zipped = F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))
    rows = df.select(*keep, F.posexplode(zipped).alias("__at", "__row"))
    numbered = [(F.col("__at") + 1).cast("bigint").alias(ordinality)] if ordinality else []
    return rows.select(*keep, *numbered, *(F.col("__row").getField(n).alias(n) for n in arrays))
