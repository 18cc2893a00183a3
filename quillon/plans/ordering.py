"""Window functions, sort orders and row limits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import windows
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

plans.sql(
    "q_window_ranks",
    """
    SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS r,
           CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS d, percent_rank() OVER w AS p, cume_dist() OVER w AS c, CAST(ntile(3) OVER w AS BIGINT) AS t
    FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)
    """,
)
plans.sql(
    "q_window_neighbours",
    """
    SELECT event_id, lag(value, 1, -1.0) OVER w AS before, lead(event_type, 2) OVER w AS later, first_value(event_id) OVER w AS first,
           nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
           last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
    FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
plans.sql("q_window_whole", "SELECT n_nationkey, count(*) OVER () AS n, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS top FROM {nation}")
plans.sql("q_rows_frame", "SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS near, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS 2 PRECEDING) AS DOUBLE) AS past FROM {lineitem}")
plans.sql("q_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {part}")
plans.sql("q_range_interval_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS recent FROM {orders}", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS recent FROM orders")
plans.sql("q_default_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS up_to FROM {part}")
plans.sql("q_inherited_window", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n FROM {orders}", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders")


@plans.query("q_groups_frame", "SELECT p_partkey, count(*) OVER w AS near, CAST(sum(p_size) OVER w AS BIGINT) AS total FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def groups_frame(spark, sf_dir):
    part = Lake(spark, sf_dir).part
    return windows.groups_frame(part, ["p_brand"], "p_size", -1, 1, {"near": lambda w: F.count("*").over(w), "total": lambda w: F.sum("p_size").over(w)}).select("p_partkey", "near", "total")


def _excluding(how: str, name: str) -> None:
    sql = f"SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_type ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {how.upper()}) AS BIGINT) AS total FROM part"
    # Ties make rows of a frame ambiguous unless the order is total; the brand's parts are ordered by key too.
    sql = sql.replace("p_size, p_type", "p_size" if how != "current row" else "p_size, p_partkey")
    order = ["p_size"] if how != "current row" else ["p_size", "p_partkey"]
    if how != "current row":  # whole partitions as frames, whose rows don't depend on the order of ties
        sql = sql.replace("ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING", "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    frame = (-3, 2) if how == "current row" else (None, None)

    @plans.query(name, sql)
    def excluding(spark, sf_dir):
        return windows.sum_excluding(Lake(spark, sf_dir).part, ["p_brand"], order, "p_partkey", frame, how, "total").select("p_partkey", "total")


_excluding("current row", "q_exclude_current_row")
_excluding("group", "q_exclude_group")
_excluding("ties", "q_exclude_ties")


@plans.query("q_filter_over", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS large FROM orders")
def filter_over(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return Lake(spark, sf_dir).orders.select("o_orderkey", windows.filter_over(F.count, F.lit(1), F.col("o_totalprice") > 100000, w).alias("large"))


@plans.query("q_top_k_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_per_group(spark, sf_dir):
    return windows.top_k(Lake(spark, sf_dir).orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


plans.sql("q_top_orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10")
plans.sql("q_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey NULLS LAST LIMIT 7 OFFSET 20")
plans.sql("q_order_by_ordinal", "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY 1 ORDER BY 2 DESC, 1")
plans.sql("q_null_order", "SELECT doc_id, CAST(row_number() OVER (ORDER BY lang ASC NULLS LAST, doc_id) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY lang DESC NULLS FIRST, doc_id) AS BIGINT) AS down FROM (SELECT doc_id, max(lang) AS lang FROM {labels} LEFT JOIN {documents} USING (doc_id) GROUP BY doc_id) d")
plans.sql("q_fetch_first", "SELECT s_suppkey FROM {supplier} ORDER BY s_acctbal DESC, s_suppkey LIMIT 5", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey FETCH FIRST 5 ROWS ONLY")


@plans.query("q_fetch_with_ties", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 5")
def fetch_with_ties(spark, sf_dir):
    return windows.with_ties(Lake(spark, sf_dir).part.select("p_partkey", "p_size"), [F.col("p_size").desc_nulls_first()], 5)
