"""Projection, predicates and scalar expressions of the relational core."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import pg
from quillon.operators import windows
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

plans.sql("q_where", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity >= 45 AND (l_discount < 0.02 OR NOT l_returnflag = 'N')")
plans.sql("q_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
plans.sql("q_between_in", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_partkey NOT IN (11, 12, 13) AND p_size NOT BETWEEN 14 AND 15")
plans.sql("q_like", r"SELECT c_custkey, c_mktsegment LIKE 'B%G' AS a, c_mktsegment NOT LIKE '%M_C%' AS b, c_mktsegment ILIKE 'auto%' AS c, '10%' LIKE '10!%' ESCAPE '!' AS d FROM {customer}")
plans.sql("q_null_tests", "SELECT doc_id, lang IS NULL AS a, lang IS NOT NULL AS b, (lang = 'en') IS TRUE AS c, (lang = 'en') IS NOT FALSE AS d, lang IS DISTINCT FROM source AS e, lang IS NOT DISTINCT FROM lang AS f FROM {documents}")
plans.sql("q_is_unknown", "SELECT doc_id FROM {documents} WHERE (nullif(lang, 'en') = 'de') IS UNKNOWN OR text IS NULL", "SELECT doc_id FROM documents WHERE (nullif(lang, 'en') = 'de') IS NULL OR text IS NULL")
plans.sql("q_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS size FROM {orders}")
plans.sql("q_conditional", "SELECT doc_id, coalesce(lang, source, '-') AS a, nullif(lang, 'en') AS b, greatest(n_chars, 100) AS c, least(n_chars, 100) AS d FROM {documents}")
plans.sql("q_cast", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS i, CAST(o_orderdate AS DATE) AS d, o_orderkey::DOUBLE / 4 AS q FROM {orders}", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS i, CAST(o_orderdate AS DATE) AS d, o_orderkey::DOUBLE / 4 AS q FROM orders")
plans.sql("q_row_compare", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM {orders} WHERE o_orderstatus = 'F') OR (l_quantity, l_linenumber) = (10.0D, 3)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F') OR (l_quantity = 10 AND l_linenumber = 3)")
plans.sql("q_typed_literals", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-03-01' + INTERVAL '3' MONTH", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-03-01' + INTERVAL 3 MONTH")


@plans.query("q_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def parameters(spark, sf_dir):
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least", args={"status": "F", "least": 200000.0}, orders=Lake(spark, sf_dir).orders)


@plans.query("q_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS FIRST, o_orderkey")
def distinct_on(spark, sf_dir):
    rows = windows.distinct_on(Lake(spark, sf_dir).orders, ["o_custkey"], [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").asc_nulls_last()])
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@plans.query("q_between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN least(30, p_partkey % 40) AND greatest(30, p_partkey % 40)")
def between_symmetric(spark, sf_dir):
    return Lake(spark, sf_dir).part.filter(pg.between_symmetric("p_size", F.lit(30), F.col("p_partkey") % 40)).select("p_partkey")


@plans.query("q_similar_to", "SELECT p_partkey, p_type SIMILAR TO '(STANDARD|PROMO).*' AS a, p_brand SIMILAR TO 'Brand.[1-3]_?.*' AS b FROM part")
def similar_to(spark, sf_dir):
    return Lake(spark, sf_dir).part.select("p_partkey", pg.similar_to("p_type", "(STANDARD|PROMO)%").alias("a"), pg.similar_to("p_brand", "Brand_[1-3]\\_?%").alias("b"))


@plans.query("q_posix_regex", "SELECT p_partkey, regexp_matches(p_type, 'PL.TED') AS a, regexp_matches(p_type, '^pr', 'i') AS b, NOT regexp_matches(p_brand, '[13]$') AS c FROM part")
def posix_regex(spark, sf_dir):
    return Lake(spark, sf_dir).part.select("p_partkey", pg.matches("p_type", "PL.TED").alias("a"), pg.matches("p_type", "^pr", "i").alias("b"), (~pg.matches("p_brand", "[13]$")).alias("c"))


@plans.query("q_overlaps", "SELECT o_orderkey FROM orders WHERE (o_orderdate < TIMESTAMP '1996-01-01' AND TIMESTAMP '1995-12-01' < o_orderdate + INTERVAL 10 DAY)")
def overlaps(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    period = pg.overlaps(F.col("o_orderdate") + F.expr("interval 10 days"), F.col("o_orderdate"), day("1995-12-01"), day("1996-01-01"))
    return Lake(spark, sf_dir).orders.filter(period).select("o_orderkey")


@plans.query("q_any_all_array", "SELECT p_partkey, list_bool_or([p_size = x FOR x IN [1, 5, 9]]) AS a, list_bool_and([p_size > x FOR x IN [1, 5, 9]]) AS b FROM part")
def any_all_array(spark, sf_dir):
    values = F.array(F.lit(1), F.lit(5), F.lit(9))
    return Lake(spark, sf_dir).part.select("p_partkey", pg.any_of("p_size", "=", values).alias("a"), pg.all_of("p_size", ">", values).alias("b"))


@plans.query("q_num_nulls", "SELECT doc_id, CAST((text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT AS INTEGER) AS a, CAST((text IS NOT NULL)::INT + (lang IS NOT NULL)::INT AS INTEGER) AS b FROM documents")
def num_nulls(spark, sf_dir):
    return Lake(spark, sf_dir).documents.select("doc_id", pg.num_nulls("text", "lang", "source").alias("a"), pg.num_nonnulls("text", "lang").alias("b"))


@plans.query("q_wildcard_expansion", "SELECT * FROM supplier")
def wildcard_expansion(spark, sf_dir):
    supplier = Lake(spark, sf_dir).supplier
    return supplier.select(*supplier.columns)
