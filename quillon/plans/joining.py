"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import joins
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

plans.sql("q_join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
plans.sql("q_join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 GROUP BY c.c_custkey")
plans.sql("q_join_right", "SELECT s.s_suppkey, n.n_name FROM {supplier} s RIGHT JOIN {nation} n ON s.s_nationkey = n.n_nationkey")
plans.sql("q_join_full", "SELECT l.doc_id AS label_id, d.doc_id AS doc_id, l.quality FROM {labels} l FULL JOIN {documents} d ON l.doc_id = d.doc_id + 1")
plans.sql("q_join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
plans.sql("q_join_comma", "SELECT r.r_name, n.n_name FROM {region} r, {nation} n WHERE r.r_regionkey = n.n_regionkey AND n.n_name > r.r_name")
plans.sql("q_join_natural", "SELECT doc_id, quality, source FROM {labels} NATURAL JOIN {documents}")
plans.sql("q_join_using", "SELECT doc_id, quality, lang FROM {documents} FULL JOIN {labels} USING (doc_id)")
plans.sql("q_join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
plans.sql("q_join_tree", "SELECT c.c_custkey, x.o_orderkey, x.l_linenumber FROM {customer} c LEFT JOIN ({orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 48) x ON x.o_custkey = c.c_custkey", "SELECT c.c_custkey, o.o_orderkey, l.l_linenumber FROM customer c LEFT JOIN (orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 48) ON o.o_custkey = c.c_custkey")
plans.sql("q_semi_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
plans.sql("q_semi_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)")
plans.sql("q_anti_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
plans.sql("q_scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM {orders})")
plans.sql("q_scalar_correlated", "SELECT p_partkey, (SELECT max(l_quantity) FROM {lineitem} WHERE l_partkey = p_partkey) AS most FROM {part}")
plans.sql("q_array_subquery", "SELECT r.r_name, array_join(sort_array((SELECT collect_list(n_name) FROM {nation} WHERE n_regionkey = r.r_regionkey)), ',') AS names FROM {region} r", "SELECT r.r_name, array_to_string(list_sort(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r.r_regionkey)), ',') AS names FROM region r")


@plans.query("q_not_in_nulls", "SELECT doc_id FROM documents WHERE lang NOT IN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def not_in_nulls(spark, sf_dir):
    docs = Lake(spark, sf_dir).documents
    return joins.not_in(docs.select("doc_id", "lang"), "lang", docs.filter("source is not null"), "source").select("doc_id")


@plans.query("q_not_in_with_null", "SELECT 'holed' AS which, (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN r_regionkey END FROM region)) AS n UNION ALL SELECT 'whole', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2))")
def not_in_with_null(spark, sf_dir):
    """A null among the values leaves no row; without it those that aren't in stay."""
    t = Lake(spark, sf_dir)
    holed = t.region.select(F.when(F.col("r_regionkey") > 2, F.col("r_regionkey")).alias("v"))
    count = lambda which, values: joins.not_in(t.nation, "n_regionkey", values, "v").agg(F.lit(which).alias("which"), F.count("*").alias("n"))
    return count("holed", holed).unionByName(count("whole", holed.filter("v is not null")))


@plans.query("q_greater_than_all", "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')")
def greater_than_all(spark, sf_dir):
    orders = Lake(spark, sf_dir).orders
    some = orders.filter("o_orderstatus = 'P'").select(F.col("o_totalprice").alias("v"))
    return joins.quantified(orders, "o_totalprice", ">=", "all", some, "v").select("o_orderkey")


@plans.query("q_less_than_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3)")
def less_than_any(spark, sf_dir):
    t = Lake(spark, sf_dir)
    return joins.quantified(t.supplier, "s_acctbal", "<", "any", t.customer.filter("c_nationkey = 3"), "c_acctbal").select("s_suppkey")


_TOP = "SELECT c_custkey, o_orderkey FROM customer {how} JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) ON true"


def _lateral(spark, sf_dir, how):
    t = Lake(spark, sf_dir)
    return joins.lateral_top(t.customer, t.orders, [("c_custkey", "o_custkey")], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, how).select("c_custkey", "o_orderkey")


@plans.query("q_lateral", _TOP.format(how=""))
def lateral(spark, sf_dir):
    return _lateral(spark, sf_dir, "inner")


@plans.query("q_lateral_left", _TOP.format(how="LEFT"))
def lateral_left(spark, sf_dir):
    return _lateral(spark, sf_dir, "left")


_BANDS = "(SELECT DISTINCT CAST(p_size AS DOUBLE) * 900 AS lo, CAST(p_size AS DOUBLE) * 900 + 1500 AS hi FROM part)"


def _bands(t):
    return t.part.select((F.col("p_size").cast("double") * 900).alias("lo"), (F.col("p_size").cast("double") * 900 + 1500).alias("hi")).distinct()


@plans.query("q_range_join", f"SELECT o_orderkey, lo FROM orders JOIN {_BANDS} ON o_totalprice >= lo AND o_totalprice < hi")
def range_join(spark, sf_dir):
    t = Lake(spark, sf_dir)
    return joins.range_join(t.orders, _bands(t), "o_totalprice", "lo", "hi", 1500.0).select("o_orderkey", "lo")


@plans.query("q_overlap_join", f"SELECT a.lo AS a, b.lo AS b FROM {_BANDS} a JOIN {_BANDS} b ON a.lo < b.hi AND b.lo < a.hi")
def overlap_join(spark, sf_dir):
    bands = _bands(Lake(spark, sf_dir))
    other = bands.select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return joins.overlap_join(bands, other, ("lo", "hi"), ("lo2", "hi2"), 1500.0).select(F.col("lo").alias("a"), F.col("lo2").alias("b"))


@plans.query(
    "q_asof_join",
    """
    SELECT e.event_id, max(p.ts) AS last_purchase FROM events e
    LEFT JOIN events p ON p.user_id = e.user_id AND p.ts <= e.ts AND p.event_type = 'purchase'
    WHERE e.event_type <> 'purchase' GROUP BY e.event_id
    """,
)
def asof_join(spark, sf_dir):
    events = Lake(spark, sf_dir).events
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("ts").alias("last_purchase"))
    others = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(others, bought, ["user_id"], "ts", "bought", ["last_purchase"]).select("event_id", "last_purchase")
