"""Set operations, common table expressions and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import recursive
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

plans.sql("q_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
plans.sql("q_union_all", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM {supplier}")
plans.sql("q_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
plans.sql("q_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
plans.sql("q_except", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49")
plans.sql("q_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
plans.sql("q_set_precedence", "SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM {nation} WHERE n_nationkey > 10 INTERSECT SELECT n_regionkey + 11 FROM {nation}")
plans.sql("q_set_order_limit", "(SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}) ORDER BY k DESC LIMIT 4")
plans.sql("q_cte", "WITH big(k, total) AS (SELECT o_custkey, max(o_totalprice) FROM {orders} GROUP BY o_custkey), named AS (SELECT c_name, total FROM big JOIN {customer} ON c_custkey = k) SELECT c_name, total FROM named WHERE total > 200000")
plans.sql("q_cte_twice", "WITH t AS (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) SELECT a.k, b.k AS other FROM t a JOIN t b ON a.n = b.n AND a.k < b.k")
plans.sql("q_recursive_union_all", "WITH RECURSIVE t(k, level) AS (SELECT r_regionkey, 0 FROM {region} UNION ALL SELECT k + 10, level + 1 FROM t WHERE level < 5) SELECT k, level FROM t")

#: Every part points to the one with half its number: a tree to search, and with the root's edge a cycle.
_TREE = "(SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 AND p_partkey < 64)"


def _tree(spark, sf_dir):
    return Lake(spark, sf_dir).part.filter("p_partkey > 1 and p_partkey < 64").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


@plans.query("q_recursive_union", "WITH RECURSIVE t(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT src FROM t JOIN (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1) ON dst = node) SELECT node FROM t WHERE node > 1")
def recursive_union(spark, sf_dir):
    """Whatever hangs on part 1, each part once."""
    down = Lake(spark, sf_dir).part.filter("p_partkey > 1").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    start = spark.range(1, 2).withColumnRenamed("id", "node")
    return recursive.reachable(down, start)


@plans.query("q_transitive_closure", f"WITH RECURSIVE e AS {_TREE}, t(src, dst) AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src) SELECT src, dst FROM t")
def transitive_closure(spark, sf_dir):
    return recursive.closure(_tree(spark, sf_dir))


@plans.query(
    "q_search_depth_first",
    f"""
    WITH RECURSIVE e AS {_TREE}, t(node, path, depth) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)], 0 UNION ALL
      SELECT e.src, list_append(t.path, e.src), t.depth + 1 FROM t JOIN e ON e.dst = t.node)
    SELECT node, depth, array_to_string(path, '>') AS path, row_number() OVER (ORDER BY path) AS place FROM t
    """,
)
def search_depth_first(spark, sf_dir):
    down = _tree(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = recursive.paths(down, spark.range(1, 2).withColumnRenamed("id", "node"))
    rows = found.select("node", "depth", "path")
    placed = spark.sql("SELECT node, depth, array_join(path, '>') AS path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS place FROM {rows}", rows=rows)
    return placed


@plans.query("q_search_breadth_first", f"WITH RECURSIVE e AS {_TREE}, t(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT e.src, t.depth + 1 FROM t JOIN e ON e.dst = t.node) SELECT node, depth FROM t ORDER BY depth, node")
def search_breadth_first(spark, sf_dir):
    down = _tree(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return recursive.paths(down, spark.range(1, 2).withColumnRenamed("id", "node")).select("node", "depth").orderBy("depth", "node")


@plans.query(
    "q_cycle_marks",
    """
    WITH RECURSIVE e AS (SELECT r_regionkey AS src, (r_regionkey + 1) % 5 AS dst FROM region UNION ALL SELECT 2, 0),
    t(node, path, depth, is_cycle) AS (SELECT 0, [0], 0, false UNION ALL
      SELECT e.dst, list_append(t.path, e.dst), t.depth + 1, list_contains(t.path, e.dst) FROM t JOIN e ON e.src = t.node WHERE NOT t.is_cycle)
    SELECT node, array_to_string(path, '>') AS path, depth, is_cycle FROM t
    """,
)
def cycle_marks(spark, sf_dir):
    region = Lake(spark, sf_dir).region
    edges = region.select(F.col("r_regionkey").alias("src"), ((F.col("r_regionkey") + 1) % 5).alias("dst"))
    edges = edges.unionByName(spark.createDataFrame([(2, 0)], "src int, dst int"))
    found = recursive.paths(edges, spark.createDataFrame([(0,)], "node int"))
    return found.select("node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth", "is_cycle")
