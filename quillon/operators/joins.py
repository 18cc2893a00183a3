"""Joins beyond equality: quantified, null-aware, lateral, range and as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def not_in(df: DataFrame, column: str, values: DataFrame, key: str) -> DataFrame:
    """NOT IN (subquery): no row if any value is null, none for a null unless there are no values."""
    stats = values.agg(F.count("*").alias("__n"), F.count(key).alias("__filled"))
    kept = df.join(values.select(F.col(key).alias("__v")).filter("__v is not null").distinct(), F.col(column) == F.col("__v"), "left_anti")
    kept = kept.crossJoin(F.broadcast(stats))  # one row
    return kept.filter((F.col("__n") == 0) | ((F.col("__n") == F.col("__filled")) & F.col(column).isNotNull())).drop("__n", "__filled")


def quantified(df: DataFrame, column: str, op: str, quantifier: str, values: DataFrame, key: str) -> DataFrame:
    """Rows for which ``column op ANY|ALL (values)`` is true; by the extremes of the values.

    One aggregate row is broadcast, whatever the number of values; nulls and an
    empty set follow three-valued logic.
    """
    v = F.col(key)
    one = F.broadcast(values.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count("*").alias("__n"), F.count(v).alias("__filled")))
    x, lo, hi = F.col(column), F.col("__lo"), F.col("__hi")
    whole = F.col("__n") == F.col("__filled")
    if quantifier == "any":
        if op == "=":
            return df.join(values.select(v.alias("__v")).distinct(), x == F.col("__v"), "left_semi")
        true = {"<": x < hi, "<=": x <= hi, ">": x > lo, ">=": x >= lo, "<>": (lo != hi) | (x != lo)}[op]
        hit = (F.col("__filled") > 0) & x.isNotNull() & true
    else:
        if op == "<>":
            return not_in(df, column, values, key)
        true = {"<": x < lo, "<=": x <= lo, ">": x > hi, ">=": x >= hi, "=": (lo == hi) & (x == lo)}[op]
        hit = (F.col("__n") == 0) | (whole & true)
    return df.crossJoin(one).filter(hit).drop("__lo", "__hi", "__n", "__filled")


def lateral_top(outer: DataFrame, inner: DataFrame, on: Sequence[tuple[str, str]], order: Sequence[Column], k: int, how: str = "inner") -> DataFrame:
    """For each outer row the first k inner rows with equal keys: limited once for each key, then joined."""
    w = Window.partitionBy(*(b for _, b in on)).orderBy(*order)
    best = inner.withColumn("__nth", F.row_number().over(w)).filter(F.col("__nth") <= k)
    return outer.join(best, [F.col(a) == F.col(b) for a, b in on], how)


def _level(low: Column, high: Column, width: float) -> Column:
    """The power of two of ``width`` that a range fits into."""
    return F.greatest(F.lit(0), F.ceil(F.log2((high.cast("double") - low.cast("double")) / width))).cast("int")


def _cell(c: Column, level: Column, width: float) -> Column:
    return F.floor(c.cast("double") / (width * F.pow(F.lit(2.0), level))).cast("bigint")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows with low <= point < high as an equality join on nested cells.

    Cells are ``width`` times a power of two wide. A range is posted at the level
    of its own length, in two cells at most however long it is; a point once at
    each level that occurs, of which there can't be more than some hundred. A width
    near the typical length of a range keeps them few. ``how`` is inner or left.
    """
    posted = right.filter(F.col(low) < F.col(high)).withColumn("__level", _level(F.col(low), F.col(high), width))
    levels = sorted(r[0] for r in posted.select("__level").distinct().collect())
    posted = posted.withColumn("__cell", F.explode(F.sequence(_cell(F.col(low), F.col("__level"), width), _cell(F.col(high), F.col("__level"), width))))
    points = left.withColumn("__at", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__place", _cell(F.col(point), F.col("__at"), width))
    inside = (F.col("__at") == F.col("__level")) & (F.col("__place") == F.col("__cell")) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    found = points.join(posted, inside).drop("__at", "__place", "__level", "__cell")
    if how == "inner":
        return found
    lone = left.join(found.select(F.col(point).alias("__met")).distinct(), F.col(point) == F.col("__met"), "left_anti")  # whether a point is in a range depends on nothing else
    return found.unionByName(lone.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema)))


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of half-open ranges that overlap, each once: at the level of the longer, in the cell where the later one starts.

    Each range is posted at its own level of nested cells and at every wider one that occurs, in two cells at most each.
    """
    sides = [(df.filter(F.col(r[0]) < F.col(r[1])), r) for df, r in ((left, a), (right, b))]
    levelled = [df.withColumn(name, _level(F.col(r[0]), F.col(r[1]), width)) for (df, r), name in zip(sides, ("__l", "__r"), strict=True)]
    levels = sorted({r[0] for df, name in zip(levelled, ("__l", "__r"), strict=True) for r in df.select(name).distinct().collect()})

    def post(df: DataFrame, r: tuple[str, str], own: str, at: str, cell: str) -> DataFrame:
        df = df.withColumn(at, F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col(own))))
        return df.withColumn(cell, F.explode(F.sequence(_cell(F.col(r[0]), F.col(at), width), _cell(F.col(r[1]), F.col(at), width))))

    x, y = post(levelled[0], a, "__l", "__m", "__x"), post(levelled[1], b, "__r", "__n", "__y")
    meet = (F.col("__m") == F.col("__n")) & (F.col("__x") == F.col("__y")) & (F.col("__m") == F.greatest("__l", "__r")) & (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("__x") == _cell(F.greatest(F.col(a[0]), F.col(b[0])), F.col("__m"), width))
    return x.join(y, meet).drop("__l", "__r", "__m", "__n", "__x", "__y")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], width: float = 86_400.0) -> DataFrame:
    """Each left row with the values of the last right row at or before it, by sorted unions of buckets.

    A bucket is ``width`` long (seconds for times), so the rows of one key are spread
    over tasks; where a bucket has nothing earlier, the last right row of the key's
    buckets before is carried on, by a window over one row for each key and bucket. A
    null key or time on either side matches nothing; such left rows stay without values.
    """
    span = lambda c: F.floor(c.cast("timestamp").cast("double") / width if dict(left.dtypes)[left_time].startswith(("timestamp", "date")) else c.cast("double") / width).cast("bigint")
    a = left.select(*left.columns, F.col(left_time).alias("__t"), F.lit(1).alias("__side"))
    held = F.struct(F.col(right_time).alias("__rt"), *(F.col(v) for v in values))
    given = right.filter(" and ".join(f"`{c}` is not null" for c in (*keys, right_time)))
    b = given.select(*(F.col(k) for k in keys), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), held.alias("__held"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__bucket", span(F.col("__t")))
    w = Window.partitionBy(*keys, "__bucket").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("__held", F.last("__held", ignorenulls=True).over(w)).filter("__side = 1")
    # The last right row of each bucket, and of the buckets before each bucket that left rows are in.
    ends = b.withColumn("__bucket", span(F.col("__t"))).groupBy(*keys, "__bucket").agg(F.max_by("__held", "__t").alias("__end"))
    asked = a.filter("__t is not null").select(*keys, span(F.col("__t")).alias("__bucket")).distinct()
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    known = asked.withColumn("__asked", F.lit(True)).join(ends, [*keys, "__bucket"], "full").withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).filter("__asked")
    known = known.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__bucket").alias("__b"), "__carried")
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    out = own.join(known, same, "left").withColumn("__held", F.coalesce("__held", "__carried"))
    return out.select(*left.columns, *(F.col(f"__held.{v}").alias(v) for v in values))


def inherit(parent: DataFrame, children: Sequence[DataFrame], only: bool = False) -> DataFrame:
    """A scan of a parent table: its own rows, and its children's unless ONLY is asked for."""
    for child in () if only else children:
        parent = parent.unionByName(child.select(*parent.columns))
    return parent
