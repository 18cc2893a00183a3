"""Relational core: joins, grouping, sets and limits over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.base import Lake, Plans

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles


@plans.query(
    "q_revenue_by_nation",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
           count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name
    """,
)
def revenue_by_nation(spark, sf_dir):
    t = Lake(spark, sf_dir)
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.count("*").alias("n_lines"),
        )
        .orderBy(F.col("revenue").desc_nulls_first(), F.col("n_name").asc_nulls_last())
    )
