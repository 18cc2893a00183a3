"""Schema comparison, dependency graphs and rules over metadata.

The metadata is that of an invented order database, written as rows; the other
version of it is made by rules. Graphs over ``part`` and ``orders`` show the same
operators on data that grows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import catalog, graph, schema
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

CONSTRAINTS = "schema string, table string, name string, kind string, columns array<string>, ref_table string, ref_columns array<string>, on_delete string, on_update string, expression string, nulls_not_distinct boolean, include array<string>"
INDEXES = "schema string, table string, name string, columns array<string>, is_unique boolean, method string, predicate string"


def _columns(spark, *rows):
    """(table, name, ordinal, type, nullable, default) as a columns table."""
    return spark.createDataFrame([("app", t, n, i, k, null, d, None, None) for t, n, i, k, null, d in rows], catalog.COLUMNS)


def _constraints(spark, *rows):
    return spark.createDataFrame([("app", t, n, k, c, rt, rc, od, None, e, False, None) for t, n, k, c, rt, rc, od, e in rows], CONSTRAINTS)


def _old(spark):
    return _columns(spark, ("customer", "id", 1, "int", False, None), ("customer", "name", 2, "varchar(40)", True, None), ("customer", "note", 3, "text", True, None), ("orders", "id", 1, "bigint", False, None), ("orders", "placed", 2, "timestamp", True, "now()"))


def _new(spark):
    return _columns(spark, ("customer", "ID", 1, "integer", False, None), ("customer", "name", 2, "character varying(80)", True, None), ("orders", "id", 1, "int8", False, None), ("orders", "placed", 2, "timestamp", False, "NOW( )"), ("orders", "total", 3, "numeric(12,2)", True, "(0)"))


@plans.query("q_schema_diff_columns", "SELECT * FROM (VALUES ('app', 'customer', 'name', 'alter', 'type'), ('app', 'customer', 'note', 'drop', ''), ('app', 'orders', 'placed', 'alter', 'nullable'), ('app', 'orders', 'total', 'add', '')) t(\"schema\", \"table\", name, change, fields)")
def schema_diff_columns(spark, sf_dir):
    return schema.diff_columns(_new(spark), _old(spark))


@plans.query("q_schema_diff_order", "SELECT 'app' AS \"schema\", 'a' AS \"table\"")
def schema_diff_order(spark, sf_dir):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 2)]
    swapped = [("a", "y", 1), ("a", "x", 2), ("b", "x", 1), ("b", "w", 2)]
    made = lambda some: _columns(spark, *((t, n, i, "text", True, None) for t, n, i in some))
    return schema.diff_order(made(rows), made(swapped))


def _keys(spark):
    return _constraints(
        spark,
        ("orders", "orders_pk", "p", ["id"], None, None, None, None),
        ("orders", "orders_customer", "f", ["customer_id"], "customer", ["id"], None, None),
        ("orders", "orders_part", "f", ["part_id", "lot"], "part", ["id", "lot"], "cascade", None),
        ("orders", None, "c", None, None, None, None, "((total >= 0))"),
        ("customer", "customer_mail", "u", ["mail", "name"], None, None, None, None),
    )


def _keys_before(spark):
    return _constraints(
        spark,
        ("orders", "orders_pk", "p", ["ID"], None, None, None, None),
        ("orders", "fk", "f", ["customer_id"], "customer", ["id"], "no action", None),
        ("orders", "check", "c", None, None, None, None, "total>=0::numeric"),
        ("orders", "old_check", "c", None, None, None, None, "total < 10"),
        ("customer", "mail_name", "u", ["name", "mail"], None, None, None, None),
    )


@plans.query("q_schema_diff_constraints", "SELECT * FROM (VALUES ('f', 'orders', 'add'), ('c', 'orders', 'drop')) t(kind, \"table\", change)")
def schema_diff_constraints(spark, sf_dir):
    """Only what differs by signature: names, cases, brackets and NO ACTION don't count."""
    parts = [schema.diff_constraints(_keys(spark), _keys_before(spark), k).select(F.lit(k).alias("kind"), "table", "change") for k in "pufc"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _objects(spark, *rows):
    return spark.createDataFrame([(k, "app", n, b) for k, n, b in rows], "kind string, schema string, name string, body string")


@plans.query("q_schema_diff_objects", "SELECT * FROM (VALUES ('view', 'app', 'fresh', 'create'), ('view', 'app', 'changed', 'alter'), ('view', 'app', 'gone', 'drop')) t(kind, \"schema\", name, change)")
def schema_diff_objects(spark, sf_dir):
    new = _objects(spark, ("view", "same", "SELECT  a FROM t"), ("view", "changed", "select a, 'X' from t"), ("view", "fresh", "select 1"))
    old = _objects(spark, ("view", "same", "select a\nfrom T;"), ("view", "changed", "select a, 'x' from t"), ("view", "gone", "select 2"), ("function", "kept", "select 3"))
    return schema.diff_objects(new, old, drops=True)


@plans.query("q_renames", "SELECT 'table' AS kind, 'app' AS \"schema\", 'client' AS old_name, 'customer' AS new_name")
def renames(spark, sf_dir):
    side = lambda name, kind: schema.table_shape(_columns(spark, (name, "id", 1, kind, False, None), (name, "name", 2, "text", True, None), ("orders", "id", 1, "bigint", False, None))).select(F.lit("table").alias("kind"), "schema", F.col("table").alias("name"), "shape")
    return schema.renames(side("customer", "integer"), side("client", "int4"))


_CHANGES = [("drop_table", None, None, True, False), ("add_column", None, "text", True, False), ("add_column", None, "int", False, False), ("alter_type", "int", "bigint", True, False), ("alter_type", "bigint", "int", True, False), ("alter_type", "varchar(40)", "varchar(10)", True, False), ("alter_type", "text", "int", True, False), ("alter_type", "int4", "integer", True, False), ("set_not_null", None, None, True, False), ("comment", None, None, True, False)]


def _changes(spark):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(_CHANGES)], "n int, change string, old_type string, new_type string, nullable boolean, has_default boolean")


@plans.query("q_risk", "SELECT * FROM (VALUES (0, 'DataLoss', false), (1, 'Safe', false), (2, 'Dangerous', false), (3, 'Warning', true), (4, 'DataLoss', true), (5, 'DataLoss', false), (6, 'Dangerous', true), (7, 'Safe', false), (8, 'Warning', false), (9, 'Unknown', false)) t(n, risk, rewrites)")
def risk(spark, sf_dir):
    return schema.risk(_changes(spark)).select("n", "risk", "rewrites")


@plans.query("q_gates", "SELECT * FROM (VALUES (1), (2), (3), (6), (7), (8)) t(n)")
def gates(spark, sf_dir):
    return schema.gate(schema.risk(_changes(spark)), exclude=["comment"]).select("n")


@plans.query("q_content_hash", "SELECT doc_id, sha256(concat(coalesce(source, ''), chr(31), coalesce(lang, ''), chr(31), coalesce(text, ''))) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return Lake(spark, sf_dir).documents.select("doc_id", schema.content_hash("source", "lang", "text").alias("hash"))


def _indexes(spark):
    rows = [("orders", "a", ["customer_id"], False, None), ("orders", "b", ["customer_id"], False, None), ("orders", "c", ["customer_id", "placed"], False, None), ("orders", "d", ["placed"], False, "placed is not null"), ("orders", "e", ["lot", "part_id", "x"], False, None)]
    return spark.createDataFrame([("app", t, n, c, u, None, p) for t, n, c, u, p in rows], INDEXES)


@plans.query("q_uncovered_foreign_keys", "SELECT 'orders' AS \"table\", 'orders_ship' AS name")
def uncovered_foreign_keys(spark, sf_dir):
    more = _keys(spark).unionByName(_constraints(spark, ("orders", "orders_ship", "f", ["ship_id"], "ship", ["id"], None, None)))
    return schema.uncovered_foreign_keys(more, _indexes(spark)).select("table", "name")


@plans.query("q_redundant_indexes", "SELECT * FROM (VALUES ('b', 'duplicate', 'a'), ('a', 'prefix', 'c')) t(name, rule, other)")
def redundant_indexes(spark, sf_dir):
    return schema.redundant_indexes(_indexes(spark)).select("name", "rule", "other")


@plans.query("q_lint", "SELECT * FROM (VALUES ('char-type', 1), ('delete-without-where', 1), ('select-star', 1), ('not-in-subquery', 1), ('leading-wildcard', 1), ('timestamp-without-zone', 1), ('upper-case-name', 1), ('no-primary-key', 1), ('foreign-key-without-action', 1), ('unnamed-constraint', 1), ('index-duplicate', 1), ('index-prefix', 1), ('null-comparison', 1)) t(rule, n)")
def lint(spark, sf_dir):
    columns = _columns(spark, ("customer", "Code", 1, "char(3)", False, None), ("orders", "id", 1, "bigint", False, None), ("orders", "placed", 2, "timestamp", True, None))
    statements = spark.createDataFrame([("app", "f", "DELETE FROM t"), ("app", "g", "select * from t"), ("app", "h", "select a from t where a not in (select b from u) and c like '%x'"), ("app", "i", "select a from t where b = NULL")], "schema string, name string, statement string")
    found = schema.lint(columns, _keys(spark), _indexes(spark), statements)
    return found.groupBy("rule").agg(F.count("*").cast("int").alias("n"))


@plans.query("q_rule_config", "SELECT * FROM (VALUES ('a', 'error'), ('b', 'info')) t(rule, severity)")
def rule_config(spark, sf_dir):
    findings = spark.createDataFrame([("a", "info", "o", ""), ("b", "info", "o", ""), ("c", "info", "o", "")], "rule string, severity string, object string, detail string")
    config = spark.createDataFrame([("a", True, "warning", "file"), ("a", True, "error", "cli"), ("c", False, None, "file")], "rule string, enabled boolean, severity string, source string")
    return schema.configure(findings, config).select("rule", "severity")


@plans.query("q_version_gate", "SELECT * FROM (VALUES ('m', 'merge-returning', 17), ('j', 'json-table', 17)) t(name, feature, needs)")
def version_gate(spark, sf_dir):
    rows = [("m", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE RETURNING t.a"), ("j", "select * from json_table(x, '$')"), ("p", "select 1")]
    return schema.version_gate(spark.createDataFrame(rows, "name string, statement string"), 16)


@plans.query("q_lighter_locks", "SELECT * FROM (VALUES (1, 0, 'CREATE INDEX CONCURRENTLY i ON t (a)'), (2, 0, 'ALTER TABLE t ADD f NOT VALID'), (2, 1, 'VALIDATE ALTER TABLE t ADD f'), (3, 0, 'ALTER TABLE t ADD c')) t(ordinal, part, statement)")
def lighter_locks(spark, sf_dir):
    rows = [(1, "index", True, "CREATE INDEX i ON t (a)"), (2, "foreign_key", True, "ALTER TABLE t ADD f"), (3, "check", False, "ALTER TABLE t ADD c")]
    return schema.lighter_locks(spark.createDataFrame(rows, "ordinal int, kind string, named boolean, statement string")).select("ordinal", "part", "statement")


@plans.query("q_duplicate_definitions", "SELECT * FROM (VALUES ('App.T', 'b.sql', 'a.sql'), ('app.t', 'c.sql', 'a.sql')) t(name, file, first_file)")
def duplicate_definitions(spark, sf_dir):
    rows = [("app.t", "a.sql", 1), ("App.T", "b.sql", 2), ("app.u", "b.sql", 3), ("app.t", "c.sql", 4)]
    return graph.duplicates(spark.createDataFrame(rows, "name string, file string, ordinal int"))


#: Each part depends on the one with half its number, hard where the number is even; every tenth edge is of runtime.
_EDGES = "(SELECT CAST(p_partkey AS VARCHAR) AS src, CAST(p_partkey // 2 AS VARCHAR) AS dst, CASE WHEN p_partkey % 10 = 0 THEN 'runtime' WHEN p_partkey % 2 = 0 THEN 'hard' ELSE 'soft' END AS kind FROM part WHERE p_partkey > 1 AND p_partkey < 200)"


def _edges(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 10 == 0, "runtime").when(F.col("p_partkey") % 2 == 0, "hard").otherwise("soft")
    rows = Lake(spark, sf_dir).part.filter("p_partkey > 1 and p_partkey < 200")
    return rows.select(F.col("p_partkey").cast("string").alias("src"), F.expr("cast(p_partkey div 2 as string)").alias("dst"), kind.alias("kind"))


@plans.query("q_graph_edges", f"SELECT src, dst, kind FROM {_EDGES} WHERE src IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10) AND dst IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10)")
def graph_edges(spark, sf_dir):
    known = Lake(spark, sf_dir).part.filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("key"))
    edges = _edges(spark, sf_dir)
    return graph.build(edges.unionByName(edges).unionByName(edges.select("src", F.col("src").alias("dst"), "kind")), known)


@plans.query("q_graph_closure", f"WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES} WHERE kind <> 'runtime'), t(src, dst) AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src) SELECT src, dst FROM t")
def graph_closure(spark, sf_dir):
    return graph.dependencies(_edges(spark, sf_dir))


@plans.query("q_graph_dependents", f"WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES} WHERE kind <> 'runtime'), t(node) AS (SELECT src FROM e WHERE dst = '7' UNION SELECT e.src FROM t JOIN e ON t.node = e.dst) SELECT node FROM t")
def graph_dependents(spark, sf_dir):
    return graph.dependents_of(_edges(spark, sf_dir), spark.createDataFrame([("7",)], "node string"))


@plans.query("q_graph_levels", f"WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES} WHERE kind <> 'runtime'), t(node, level) AS (SELECT CAST(p_partkey AS VARCHAR), 0 FROM part WHERE p_partkey < 200 UNION SELECT e.src, t.level + 1 FROM t JOIN e ON t.node = e.dst) SELECT node, max(level) AS level FROM t GROUP BY node")
def graph_levels(spark, sf_dir):
    nodes = Lake(spark, sf_dir).part.filter("p_partkey < 200").select(F.col("p_partkey").cast("string").alias("key"))
    return graph.levels(_edges(spark, sf_dir), nodes)


@plans.query("q_graph_cycles", "SELECT * FROM (VALUES ('a', 'a', 'error'), ('b', 'a', 'error'), ('c', 'a', 'error'), ('x', 'x', 'warning'), ('y', 'x', 'warning')) t(node, component, severity)")
def graph_cycles(spark, sf_dir):
    rows = [("a", "b", "hard"), ("b", "c", "soft"), ("c", "a", "soft"), ("x", "y", "soft"), ("y", "x", "soft"), ("c", "x", "hard"), ("r", "s", "runtime"), ("s", "r", "hard"), ("z", "z", "hard")]
    return graph.cycles(spark.createDataFrame(rows, "src string, dst string, kind string"))


@plans.query("q_ordered_plan", "SELECT * FROM (VALUES (0, 'schema'), (1, 'type'), (2, 'base'), (3, 'orders'), (4, 'view'), (5, 'drop')) t(place, id)")
def ordered_plan(spark, sf_dir):
    phases = graph.PHASES
    changes = [{"id": "view", "key": "v", "phase": phases["view"]}, {"id": "orders", "key": "o", "phase": phases["table"]}, {"id": "base", "key": "b", "phase": phases["table"]}, {"id": "drop", "key": "b", "phase": phases["drop_table"], "destructive": True}, {"id": "schema", "key": "s", "phase": phases["schema"]}, {"id": "type", "key": "t", "phase": phases["type"]}]
    order = graph.plan(changes, [("v", "o", "hard"), ("o", "b", "hard"), ("o", "t", "hard"), ("b", "o", "runtime")])
    return spark.createDataFrame(list(enumerate(order)), "place int, id string")


@plans.query("q_incremental", "WITH RECURSIVE e(src, dst) AS (VALUES ('b', 'a'), ('c', 'b'), ('e', 'd'), ('g', 'f')), t(node) AS (SELECT * FROM (VALUES ('a'), ('new'), ('e')) v(n) UNION SELECT e.src FROM t JOIN e ON e.dst = t.node) SELECT k AS key, CASE WHEN k IN (SELECT node FROM t) THEN 'dirty' ELSE 'reused' END AS state FROM (VALUES ('a'), ('b'), ('c'), ('e'), ('f'), ('g'), ('new')) v(k)")
def incremental(spark, sf_dir):
    side = lambda rows: spark.createDataFrame(rows, "key string, hash string")
    now = side([("a", "2"), ("b", "1"), ("c", "1"), ("e", "1"), ("f", "1"), ("g", "1"), ("new", "1")])
    before = side([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1"), ("f", "1"), ("g", "1")])
    edges = spark.createDataFrame([("b", "a", "hard"), ("c", "b", "soft"), ("g", "f", "hard")], "src string, dst string, kind string")
    return graph.stale(now, before, edges, edges.unionByName(spark.createDataFrame([("e", "d", "hard")], edges.schema)))
