"""Comparison of two versions of a table, and changes as functions.

The second version of ``customer`` is made from the first: some rows are gone,
some differ and some are new, by rules over the key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import compare, dml
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

_OLD = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 7 <> 3"
_NEW = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 11 <> 4"
_BOTH = f"WITH t AS ({_OLD}), s AS ({_NEW}) "
_CATEGORY = "CASE WHEN t.c_custkey IS NULL THEN 'OnlyInSource' WHEN s.c_custkey IS NULL THEN 'OnlyInTarget' WHEN s.c_name IS DISTINCT FROM t.c_name OR s.c_acctbal IS DISTINCT FROM t.c_acctbal THEN 'Different' ELSE 'Identical' END"


def _versions(spark, sf_dir):
    customer = Lake(spark, sf_dir).customer
    old = customer.filter("c_custkey % 7 <> 3").select("c_custkey", "c_name", "c_acctbal")
    name = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    balance = F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = customer.filter("c_custkey % 11 <> 4").select("c_custkey", name.alias("c_name"), balance.alias("c_acctbal"))
    return new, old


@plans.query("q_compare_rows", _BOTH + f"SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, {_CATEGORY} AS category, CASE WHEN s.c_custkey IS NOT NULL AND t.c_custkey IS NOT NULL THEN concat_ws(',', CASE WHEN s.c_name IS DISTINCT FROM t.c_name THEN 'c_name' END, CASE WHEN s.c_acctbal IS DISTINCT FROM t.c_acctbal THEN 'c_acctbal' END) END AS fields FROM s FULL JOIN t ON s.c_custkey = t.c_custkey")
def compare_rows(spark, sf_dir):
    found = compare.compare(*_versions(spark, sf_dir), ["c_custkey"])
    return found.select("c_custkey", "category", F.array_join(F.transform("diffs", lambda d: d["column"]), ",").alias("fields"))


@plans.query("q_compare_summary", _BOTH + f"SELECT {_CATEGORY} AS category, count(*) AS n FROM s FULL JOIN t ON s.c_custkey = t.c_custkey GROUP BY ALL")
def compare_summary(spark, sf_dir):
    return compare.summary(compare.compare(*_versions(spark, sf_dir), ["c_custkey"]))


@plans.query("q_sync_plan", _BOTH + "SELECT CASE WHEN s.c_custkey IS NULL THEN 0 WHEN t.c_custkey IS NULL THEN 1 ELSE 2 END AS phase, CASE WHEN s.c_custkey IS NULL THEN 'delete' WHEN t.c_custkey IS NULL THEN 'insert' ELSE 'update' END AS action, coalesce(s.c_custkey, t.c_custkey) AS k FROM s FULL JOIN t ON s.c_custkey = t.c_custkey " + f"WHERE {_CATEGORY} <> 'Identical'")
def sync_plan(spark, sf_dir):
    order = compare.topological_order(["orders", "customer"], [("orders", "customer")])
    made = compare.sync_plan({"customer": compare.compare(*_versions(spark, sf_dir), ["c_custkey"])}, order, {"customer": ["c_custkey"]})
    return made.select("phase", "action", F.get_json_object("key", "$.c_custkey").cast("bigint").alias("k"))


@plans.query("q_insert_statements", "SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' AS statement FROM nation")
def insert_statements(spark, sf_dir):
    return compare.insert_statements(Lake(spark, sf_dir).nation, "nation")


@plans.query("q_insert_or_nothing", _BOTH + "SELECT * FROM t UNION ALL SELECT * FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM t)")
def insert_or_nothing(spark, sf_dir):
    new, old = _versions(spark, sf_dir)
    return dml.insert_or_nothing(old, new, ["c_custkey"])


@plans.query("q_upsert", _BOTH + "SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN s.c_name ELSE t.c_name END AS c_name, CASE WHEN t.c_custkey IS NULL OR s.c_acctbal > t.c_acctbal THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal FROM t FULL JOIN s ON s.c_custkey = t.c_custkey")
def upsert(spark, sf_dir):
    """ON CONFLICT DO UPDATE SET c_acctbal = excluded.c_acctbal WHERE it is higher."""
    new, old = _versions(spark, sf_dir)
    return dml.upsert(old, new, ["c_custkey"], {"c_acctbal": F.col("s.c_acctbal")}, F.col("s.c_acctbal") > F.col("t.c_acctbal"))


@plans.query("q_update_from", _BOTH + "SELECT t.c_custkey, CASE WHEN s.c_name IS NULL AND s.c_custkey IS NOT NULL THEN 'unknown' ELSE t.c_name END AS c_name, t.c_acctbal FROM t LEFT JOIN s ON s.c_custkey = t.c_custkey")
def update_from(spark, sf_dir):
    new, old = _versions(spark, sf_dir)
    return dml.update_from(old, new, ["c_custkey"], {"c_name": F.lit("unknown")}, F.col("s.c_name").isNull())


@plans.query("q_delete_using", _BOTH + "SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s WHERE c_name IS NULL)")
def delete_using(spark, sf_dir):
    new, old = _versions(spark, sf_dir)
    return dml.delete_using(old, new.filter("c_name is null"), ["c_custkey"])


def _merged(spark, sf_dir):
    new, old = _versions(spark, sf_dir)
    clauses = [
        dml.When("matched", "delete", F.col("s.c_name").isNull()),
        dml.When("matched", "update", F.col("s.c_acctbal") != F.col("t.c_acctbal"), {"c_acctbal": F.col("s.c_acctbal")}),
        dml.When("missing", "insert"),
        dml.When("orphan", "update", F.col("t.c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}),
    ]
    return dml.merge(old, new, ["c_custkey"], clauses)


_JOINED = _BOTH + "SELECT {} FROM t FULL JOIN s ON s.c_custkey = t.c_custkey WHERE {}"


@plans.query("q_merge", _JOINED.format("coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN s.c_name ELSE t.c_name END AS c_name, CASE WHEN t.c_custkey IS NULL THEN s.c_acctbal WHEN s.c_custkey IS NULL THEN greatest(t.c_acctbal, 0) ELSE s.c_acctbal END AS c_acctbal", "NOT (t.c_custkey IS NOT NULL AND s.c_custkey IS NOT NULL AND s.c_name IS NULL)"))
def merge(spark, sf_dir):
    return _merged(spark, sf_dir)[0]


@plans.query("q_merge_returning", _JOINED.format("CASE WHEN t.c_custkey IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'update' WHEN s.c_name IS NULL THEN 'delete' ELSE 'update' END AS action, t.c_custkey AS old_key, t.c_acctbal AS old_balance, CASE WHEN t.c_custkey IS NULL THEN s.c_acctbal WHEN s.c_custkey IS NULL THEN 0 WHEN s.c_name IS NOT NULL THEN s.c_acctbal END AS new_balance", "t.c_custkey IS NULL OR (s.c_custkey IS NULL AND t.c_acctbal < 0) OR (s.c_custkey IS NOT NULL AND (s.c_name IS NULL OR s.c_acctbal <> t.c_acctbal))"))
def merge_returning(spark, sf_dir):
    changed = _merged(spark, sf_dir)[1]
    return changed.select("action", F.col("old.c_custkey").alias("old_key"), F.col("old.c_acctbal").alias("old_balance"), F.col("new.c_acctbal").alias("new_balance"))
