"""Scans, values, set-returning functions and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import pgjson, pgxml
from quillon.operators import catalog, joins, srf
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans
from quillon.session import TABLES
from quillon.sources import copy

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

plans.sql("q_scan", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_nationkey = 7 AND c_acctbal > 0")
plans.sql("q_table_command", "TABLE {region}", "SELECT * FROM region")
plans.sql("q_values", "SELECT column1, column2 FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(column1, column2)")
plans.sql("q_subquery_in_from", "SELECT d.m, count(*) AS n FROM (SELECT month(o_orderdate) AS m FROM {orders}) AS d GROUP BY d.m", "SELECT CAST(d.m AS INTEGER) AS m, count(*) AS n FROM (SELECT month(o_orderdate) AS m FROM orders) AS d GROUP BY d.m")
plans.sql("q_star_of_table", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")


@plans.query("q_generate_series", "SELECT n_nationkey, CAST(unnest(generate_series(1, n_regionkey)) AS BIGINT) AS i FROM nation")
def generate_series(spark, sf_dir):
    return Lake(spark, sf_dir).nation.select("n_nationkey", F.explode(srf.series(1, "n_regionkey")).alias("i"))


@plans.query("q_generate_series_down", "SELECT n_nationkey, CAST(unnest(generate_series(n_regionkey, -2, -2)) AS BIGINT) AS i FROM nation")
def generate_series_down(spark, sf_dir):
    return Lake(spark, sf_dir).nation.select("n_nationkey", F.explode(srf.series("n_regionkey", -2, -2)).alias("i"))


@plans.query("q_generate_time_series", "SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 30 DAY)) AS day FROM orders")
def generate_time_series(spark, sf_dir):
    ends = Lake(spark, sf_dir).orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select(F.explode(srf.time_series("a", "b", "30 days")).alias("day"))


@plans.query("q_generate_subscripts", "SELECT p_partkey, CAST(unnest(generate_series(len(string_split(p_name, ' ')), 1, -1)) AS BIGINT) AS i FROM part")
def generate_subscripts(spark, sf_dir):
    return Lake(spark, sf_dir).part.select("p_partkey", F.explode(srf.subscripts(F.split("p_name", " "), True)).alias("i"))


@plans.query("q_unnest_with_ordinality", "SELECT p_partkey, CAST(unnest(generate_series(1, len(string_split(p_name, ' ')))) AS BIGINT) AS ord, unnest(string_split(p_name, ' ')) AS word FROM part")
def unnest_with_ordinality(spark, sf_dir):
    return srf.unnest(Lake(spark, sf_dir).part, {"word": F.split("p_name", " ")}, ["p_partkey"], "ord")


@plans.query("q_rows_from", "SELECT r_regionkey, unnest([1, 2, 3]) AS a, unnest(string_split(r_name, 'A')[:2]) AS b FROM region")
def rows_from(spark, sf_dir):
    arrays = {"a": F.array(F.lit(1), F.lit(2), F.lit(3)), "b": F.slice(F.split("r_name", "A"), 1, 2)}
    return srf.unnest(Lake(spark, sf_dir).region, arrays, ["r_regionkey"])


@plans.query("q_inheritance_scan", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_orderstatus")
def inheritance_scan(spark, sf_dir):
    t = Lake(spark, sf_dir)
    parent, child = t.orders.filter("o_orderstatus = 'O'"), t.orders.filter("o_orderstatus = 'F'")
    return joins.inherit(parent, [child]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@plans.query("q_only_scan", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderstatus")
def only_scan(spark, sf_dir):
    t = Lake(spark, sf_dir)
    parent, child = t.orders.filter("o_orderstatus = 'O'"), t.orders.filter("o_orderstatus = 'F'")
    return joins.inherit(parent, [child], only=True).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@plans.query("q_tablesample")
def tablesample(spark, sf_dir):
    """A tenth of the rows, the same for the same seed."""
    return copy.sample(Lake(spark, sf_dir).lineitem, 10, seed=42)


@plans.query("q_tablesample_bounds", "SELECT count(*) AS every, 0::BIGINT AS none, true AS tenth, true AS repeats, true AS blocks FROM lineitem")
def tablesample_bounds(spark, sf_dir):
    """All of 100 percent, none of 0, about a tenth of 10, the same again for one seed; SYSTEM takes whole partitions."""
    t = Lake(spark, sf_dir).lineitem
    count = lambda df, name: df.agg(F.count("*").alias(name))
    key = F.xxhash64("l_orderkey", "l_linenumber").cast("decimal(38,0)")
    one, two = (copy.sample(t, 10, seed=7).agg(F.count("*").alias(f"n{i}"), F.sum(key).alias(f"h{i}")) for i in (1, 2))
    parts = copy.sample(t, 50, seed=3, system=True).select(F.spark_partition_id().alias("p")).groupBy("p").count().join(t.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("all")), "p").agg(F.coalesce(F.bool_and(F.col("count") == F.col("all")), F.lit(True)).alias("blocks"))
    row = count(copy.sample(t, 100, seed=1), "every").crossJoin(count(copy.sample(t, 0, seed=1), "none")).crossJoin(one).crossJoin(two).crossJoin(parts)  # one row each
    return row.select("every", "none", ((F.col("n1") > 0.05 * F.col("every")) & (F.col("n1") < 0.15 * F.col("every"))).alias("tenth"), ((F.col("n1") == F.col("n2")) & (F.col("h1") == F.col("h2"))).alias("repeats"), "blocks")


@plans.query("q_json_table", "SELECT event_id, 1 AS ordinality, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_table(spark, sf_dir):
    return pgjson.json_table(Lake(spark, sf_dir).events.select("event_id", "props"), "props", "$", {"k": ("bigint", "$.k")}).drop("props")


@plans.query("q_xmltable", "SELECT r_regionkey, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS INTEGER) AS ordinality, n_name AS name, n_nationkey AS key FROM nation JOIN region ON n_regionkey = r_regionkey")
def xmltable(spark, sf_dir):
    t = Lake(spark, sf_dir)
    item = pgxml.element("nation", {"key": "n_nationkey"}, pgxml.forest(name="n_name"))
    made = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(pgxml.agg(item, "n_name").alias("items"))
    made = made.select("r_regionkey", F.concat(F.lit("<all>"), "items", F.lit("</all>")).alias("doc"))
    return pgxml.table(made, "doc", "/all/nation", {"name": ("string", "name"), "key": ("int", "@key")}).drop("doc")


_LISTED = ", ".join(f"'{t}'" for t in TABLES)


@plans.query("q_catalog_columns", f"SELECT table_name AS \"table\", column_name AS name, CAST(ordinal_position AS INTEGER) AS ordinal FROM information_schema.columns WHERE table_name IN ({_LISTED})")
def catalog_columns(spark, sf_dir):
    t = Lake(spark, sf_dir)
    return catalog.columns(spark, {name: getattr(t, name) for name in TABLES}).select("table", "name", "ordinal")


@plans.query("q_catalog_signatures", f"SELECT table_name AS \"table\", string_agg(column_name, ', ' ORDER BY ordinal_position) AS cols FROM information_schema.columns WHERE table_name IN ({_LISTED}) GROUP BY table_name")
def catalog_signatures(spark, sf_dir):
    from quillon.operators.aggregates import string_agg

    t = Lake(spark, sf_dir)
    every = catalog.columns(spark, {name: getattr(t, name) for name in TABLES})
    return every.groupBy("table").agg(string_agg("name", ", ", ["ordinal"]).alias("cols"))


@plans.query("q_key_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def key_violations(spark, sf_dir):
    return catalog.key_violations(Lake(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@plans.query("q_unique_violations", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return catalog.unique_violations(Lake(spark, sf_dir).customer, ["c_nationkey", "c_mktsegment"])


@plans.query("q_check_violations", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT (l_discount < 0.08)")
def check_violations(spark, sf_dir):
    return catalog.check_violations(Lake(spark, sf_dir).lineitem, "l_discount < 0.08").select("l_orderkey", "l_linenumber", "l_discount")


@plans.query("q_reference_violations", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def reference_violations(spark, sf_dir):
    t = Lake(spark, sf_dir)
    return catalog.reference_violations(t.orders, t.customer.filter("c_acctbal > 0"), [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey")
