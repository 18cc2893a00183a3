"""Aggregation. Sums of money are taken over decimals, so that they don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import aggregates as agg
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

#: Money with four decimals, summed exactly.
EXACT = "CAST(sum(CAST({} AS DECIMAL(18, 4))) AS DOUBLE)"
REVENUE = EXACT.format("l_extendedprice * (1 - l_discount)")
TOTAL = EXACT.format("o_totalprice")

plans.sql(
    "q_pricing_summary",
    f"""
    SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, {EXACT.format("l_extendedprice")} AS sum_base,
           {REVENUE} AS sum_disc, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_qty, count(*) AS n
    FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus
    """,
)
plans.sql("q_global_aggregate", f"SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, {TOTAL} AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM {{orders}}")
plans.sql("q_global_aggregate_empty", "SELECT count(*) AS n, max(o_orderkey) AS last FROM {orders} WHERE o_orderkey < 0")
plans.sql("q_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15 AND min(o_totalprice) > 1000")
plans.sql("q_having_without_group", "SELECT count(*) AS n FROM {orders} HAVING count(*) > 10")
plans.sql("q_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS TINYINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
plans.sql("q_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
plans.sql("q_grouping_cross", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_nationkey), ()), ROLLUP (c_mktsegment)")
plans.sql("q_aggregate_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, count(DISTINCT l_suppkey) FILTER (WHERE l_discount > 0.05) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
plans.sql("q_aggregate_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers FROM {lineitem} GROUP BY l_returnflag")
plans.sql("q_bit_and_bool", "SELECT c_nationkey, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x, bool_and(c_acctbal > 0) AS every_one, bool_or(c_acctbal > 9000) AS any_one FROM {customer} GROUP BY c_nationkey")
plans.sql("q_percentiles", "SELECT o_orderstatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_orderkey) AS middle, CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY o_orderkey) AS BIGINT) AS quarter FROM {orders} GROUP BY o_orderstatus")
plans.sql("q_moments", "SELECT p_brand, round(stddev_samp(p_size), 6) AS s, round(var_pop(p_size), 6) AS v, round(covar_pop(p_size, p_partkey), 4) AS c FROM {part} GROUP BY p_brand")
plans.sql("q_regression", "SELECT l_linenumber, round(corr(l_extendedprice, l_quantity), 8) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS base, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM {lineitem} GROUP BY l_linenumber")
plans.sql(
    "q_supplier_revenue",
    f"""
    SELECT n.n_name, r.r_name, {REVENUE} AS revenue
    FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{customer}} c ON o.o_custkey = c.c_custkey
    JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey
    JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
    GROUP BY n.n_name, r.r_name
    """,
)
plans.sql("q_forecast_revenue", f"SELECT {EXACT.format('l_extendedprice * l_discount')} AS revenue FROM {{lineitem}} WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
plans.sql(
    "q_large_orders",
    """
    SELECT c.c_name, o.o_orderkey, CAST(sum(l.l_quantity) AS DOUBLE) AS quantity
    FROM {orders} o JOIN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 250) big ON o.o_orderkey = big.l_orderkey
    JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
    GROUP BY c.c_name, o.o_orderkey
    """,
)


@plans.query("q_grouping_sets", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_mktsegment), ())")
def grouping_sets(spark, sf_dir):
    keys = ["c_nationkey", "c_mktsegment"]
    return agg.grouping_sets(Lake(spark, sf_dir).customer, keys, [keys, ["c_mktsegment"], []], [F.count("*").alias("n")])


@plans.query("q_group_by_distinct", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey), (c_mktsegment), ())")
def group_by_distinct(spark, sf_dir):
    """GROUP BY DISTINCT ROLLUP (nation, segment), ROLLUP (segment): equal sets count once."""
    keys = ["c_nationkey", "c_mktsegment"]
    sets = agg.cross_sets(agg.rollup_sets(keys), agg.rollup_sets(["c_mktsegment"]))
    return agg.grouping_sets(Lake(spark, sf_dir).customer, keys, sets, [F.count("*").alias("n")], distinct=True)


@plans.query("q_string_agg", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg(spark, sf_dir):
    return Lake(spark, sf_dir).nation.groupBy("n_regionkey").agg(agg.string_agg("n_name", "; ", ["n_name"]).alias("names"))


@plans.query("q_array_agg_order", "SELECT c_nationkey, array_to_string(list(c_custkey ORDER BY c_acctbal, c_custkey), ',') AS ids FROM customer GROUP BY c_nationkey")
def array_agg_order(spark, sf_dir):
    ids = agg.array_agg("c_custkey", ["c_acctbal", "c_custkey"])
    return Lake(spark, sf_dir).customer.groupBy("c_nationkey").agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@plans.query("q_mode", "SELECT c_nationkey, min(c_mktsegment) AS favourite FROM (SELECT c_nationkey, c_mktsegment, rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC) AS place FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE place = 1 GROUP BY c_nationkey")
def mode(spark, sf_dir):
    return Lake(spark, sf_dir).customer.groupBy("c_nationkey").agg(agg.mode("c_mktsegment").alias("favourite"))


@plans.query(
    "q_hypothetical_ranks",
    """
    SELECT c_nationkey, 1 + count(*) FILTER (WHERE c_acctbal < 5000) AS rank, 1 + count(DISTINCT c_acctbal) FILTER (WHERE c_acctbal < 5000) AS dense_rank,
           count(*) FILTER (WHERE c_acctbal < 5000) / count(*) AS percent_rank, (1 + count(*) FILTER (WHERE c_acctbal <= 5000)) / (1 + count(*)) AS cume_dist
    FROM customer GROUP BY c_nationkey
    """,
)
def hypothetical_ranks(spark, sf_dir):
    return Lake(spark, sf_dir).customer.groupBy("c_nationkey").agg(*(c.alias(n) for n, c in agg.hypothetical("c_acctbal", 5000.0).items()))


@plans.query("q_user_aggregate", "SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS squares FROM nation GROUP BY n_regionkey")
def user_aggregate(spark, sf_dir):
    """CREATE AGGREGATE with a transition function that adds squares."""
    squares = agg.user_aggregate(F.col("n_nationkey").cast("bigint"), F.lit(0).cast("bigint"), lambda s, v: s + v * v)
    return Lake(spark, sf_dir).nation.groupBy("n_regionkey").agg(squares.alias("squares"))


_RANGES = "(SELECT p_brand, p_partkey AS lo, p_partkey + p_size AS hi FROM part)"


def _ranges(spark, sf_dir):
    return Lake(spark, sf_dir).part.select("p_brand", F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))


@plans.query(
    "q_range_agg",
    f"""
    SELECT p_brand, min(lo) AS lo, max(hi) AS hi FROM (
      SELECT p_brand, lo, hi, sum(fresh) OVER (PARTITION BY p_brand ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT p_brand, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY p_brand ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM {_RANGES} WHERE lo < hi)) GROUP BY p_brand, island
    """,
)
def range_agg(spark, sf_dir):
    return agg.range_agg(_ranges(spark, sf_dir), ["p_brand"], "lo", "hi")


@plans.query("q_range_intersect_agg", f"SELECT p_brand, CASE WHEN max(lo) < min(hi) THEN max(lo) END AS lo, CASE WHEN max(lo) < min(hi) THEN min(hi) END AS hi FROM {_RANGES} GROUP BY p_brand")
def range_intersect_agg(spark, sf_dir):
    return agg.range_intersect_agg(_ranges(spark, sf_dir), ["p_brand"], "lo", "hi")
