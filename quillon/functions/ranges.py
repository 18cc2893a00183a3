"""Range values as structs (lower, upper, lower_inc, upper_inc, empty); null bounds are infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower, upper, bounds: str = "[)", discrete: bool = False) -> Column:
    """A range; discrete ones (integers, dates) take the canonical form [ )."""
    lo, hi = _c(lower), _c(upper)
    lower_inc, upper_inc = F.lit(bounds[0] == "[") & lo.isNotNull(), F.lit(bounds[1] == "]") & hi.isNotNull()
    if discrete:
        lo = F.when(lower_inc | lo.isNull(), lo).otherwise(lo + 1)
        hi = F.when(upper_inc, hi + 1).otherwise(hi)
        lower_inc, upper_inc = lo.isNotNull(), F.lit(False)
    wrong = lo > hi
    empty = F.coalesce((lo == hi) & ~(lower_inc & upper_inc), F.lit(False))
    made = F.struct(F.when(~empty, lo).alias("lower"), F.when(~empty, hi).alias("upper"), (lower_inc & ~empty).alias("lower_inc"), (upper_inc & ~empty).alias("upper_inc"), empty.alias("empty"))
    return F.when(F.coalesce(wrong, F.lit(False)) & F.lit(not discrete), F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound"))).otherwise(made)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def isempty(r: Column) -> Column:
    return r["empty"]


def lower_inc(r: Column) -> Column:
    return r["lower_inc"]


def upper_inc(r: Column) -> Column:
    return r["upper_inc"]


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def contains_value(r: Column, v) -> Column:
    """r @> element"""
    v = _c(v)
    above = r["lower"].isNull() | (v > r["lower"]) | ((v == r["lower"]) & r["lower_inc"])
    below = r["upper"].isNull() | (v < r["upper"]) | ((v == r["upper"]) & r["upper_inc"])
    return ~r["empty"] & above & below


def _starts_no_later(a: Column, b: Column) -> Column:
    """The lower bound of a is at or before that of b."""
    return a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))


def _ends_no_earlier(a: Column, b: Column) -> Column:
    return a["upper"].isNull() | (b["upper"].isNotNull() & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))


def contains(a: Column, b: Column) -> Column:
    """a @> b"""
    return b["empty"] | (~a["empty"] & F.coalesce(_starts_no_later(a, b), F.lit(False)) & F.coalesce(_ends_no_earlier(a, b), F.lit(False)))


def left_of(a: Column, b: Column) -> Column:
    """a << b"""
    meets = (a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"]))
    return ~a["empty"] & ~b["empty"] & F.coalesce(meets, F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """a && b"""
    return ~a["empty"] & ~b["empty"] & ~left_of(a, b) & ~left_of(b, a)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b"""
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def not_right(a: Column, b: Column) -> Column:
    """a &< b: a doesn't extend to the right of b."""
    return ~a["empty"] & ~b["empty"] & F.coalesce(_ends_no_earlier(b, a), F.lit(False))


def not_left(a: Column, b: Column) -> Column:
    """a &> b"""
    return ~a["empty"] & ~b["empty"] & F.coalesce(_starts_no_later(b, a), F.lit(False))


def _span(lo: Column, hi: Column, empty: Column) -> Column:
    return F.struct(F.when(~empty, lo["lower"]).alias("lower"), F.when(~empty, hi["upper"]).alias("upper"), (lo["lower_inc"] & ~empty).alias("lower_inc"), (hi["upper_inc"] & ~empty).alias("upper_inc"), empty.alias("empty"))


def intersection(a: Column, b: Column) -> Column:
    """a * b"""
    low = F.when(F.coalesce(_starts_no_later(a, b), F.lit(False)), b).otherwise(a)
    high = F.when(F.coalesce(_ends_no_earlier(a, b), F.lit(False)), b).otherwise(a)
    return _span(low, high, ~overlaps(a, b))


def merge(a: Column, b: Column) -> Column:
    """range_merge: the smallest range that holds both."""
    low = F.when(F.coalesce(_starts_no_later(a, b), F.lit(False)), a).otherwise(b)
    high = F.when(F.coalesce(_ends_no_earlier(a, b), F.lit(False)), a).otherwise(b)
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(_span(low, high, F.lit(False)))


def union(a: Column, b: Column) -> Column:
    """a + b; an error if a gap would lie between."""
    near = a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b)
    return F.when(near, merge(a, b)).otherwise(F.raise_error(F.lit("result of range union would not be contiguous")))


def multirange(ranges: Column) -> Column:
    """Half-open ranges as a sorted array without overlaps, gaps kept, empty ones gone."""
    rows = F.array_sort(F.transform(F.filter(ranges, lambda r: ~r["empty"]), lambda r: F.struct(r["lower"].alias("lower"), r["upper"].alias("upper"))))

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (r["lower"] <= last["upper"])
        wider = F.struct(last["lower"].alias("lower"), F.greatest(last["upper"], r["upper"]).alias("upper"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(rows, F.filter(rows, lambda r: F.lit(False)), add)


def text(r: Column) -> Column:
    """A range as it is written."""
    shown = F.concat(F.when(r["lower_inc"], "[").otherwise("("), F.coalesce(r["lower"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["upper"].cast("string"), F.lit("")), F.when(r["upper_inc"], "]").otherwise(")"))
    return F.when(r["empty"], "empty").otherwise(shown)
