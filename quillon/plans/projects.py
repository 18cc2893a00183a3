"""References, validation and the work around a project of SQL files; key and column choice; policies; scripts and functions in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillon.operators import catalog, compare, graph, project, references, schema
from quillon.plans.base import Lake, Plans

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles

_STATEMENTS = [
    ("app.v", "CREATE VIEW app.v AS SELECT o.id, app.f(o.total) FROM app.orders o JOIN app.customer c ON c.id = o.customer_id WHERE extract(year FROM o.placed) > 2000"),
    ("app.w", "CREATE VIEW app.w AS WITH x AS (SELECT * FROM app.v) SELECT * FROM x, app.lines"),
    ("app.f", "CREATE FUNCTION app.f(n numeric) RETURNS app.money AS $$ BEGIN EXECUTE 'SELECT * FROM app.late'; EXECUTE 'DROP ' || n; RETURN n::app.money; END $$"),
    ("app.g", "CREATE FUNCTION app.g() RETURNS int AS 'SELECT 1'"),
]


@plans.query("q_reference_collection", "SELECT * FROM (VALUES ('app.v', 'app.f', 'hard', 'function'), ('app.v', 'app.orders', 'hard', 'relation'), ('app.v', 'app.customer', 'hard', 'relation'), ('app.w', 'app.v', 'hard', 'relation'), ('app.w', 'app.lines', 'hard', 'relation'), ('app.f', 'app.f', 'hard', 'function'), ('app.f', 'app.money', 'hard', 'type'), ('app.f', 'app.late', 'runtime', 'relation'), ('app.g', 'app.g', 'hard', 'function')) t(src, dst, kind, how)")
def reference_collection(spark, sf_dir):
    return references.references(spark.createDataFrame(_STATEMENTS, "name string, statement string"))


@plans.query("q_runtime_edges", "SELECT * FROM (VALUES ('app.f', 'app.late', 'runtime'), ('app.f', 'app.money', 'hard'), ('app.v', 'app.f', 'hard'), ('app.w', 'app.v', 'hard')) t(src, dst, kind)")
def runtime_edges(spark, sf_dir):
    """The graph that references between known objects make; runtime edges are those of EXECUTE."""
    nodes = spark.createDataFrame([(n,) for n in ("app.v", "app.w", "app.f", "app.g", "app.late", "app.money")], "key string")
    return graph.build(references.references(spark.createDataFrame(_STATEMENTS, "name string, statement string")), nodes)


@plans.query("q_semantic_findings", "SELECT * FROM (VALUES ('a', 'unknown-relation', 'gone'), ('a', 'unknown-column', 'o.o_nothing'), ('b', 'insert-arity', '2 values for 3 columns'), ('c', 'insert-arity', '1 values for 3 columns')) t(name, rule, detail)")
def semantic_findings(spark, sf_dir):
    """Statements against the catalog of the tables themselves; elsewhere.t is another project's."""
    t = Lake(spark, sf_dir)
    columns = catalog.columns(spark, {"orders": t.orders, "region": t.region.select("r_regionkey", "r_name").withColumn("r_comment", F.lit(""))})
    rows = [("a", "select o.o_orderkey, o.o_nothing from orders o join gone g on g.x = o.o_orderkey"), ("b", "insert into region (r_regionkey, r_name, r_comment) values (1, 'x')"), ("c", "insert into region values (1)"), ("d", "select * from elsewhere.t"), ("e", "insert into region (r_regionkey) values (1), (2)"), ("f", None)]
    return references.findings(spark.createDataFrame(rows, "name string, statement string"), columns, spark.createDataFrame([("elsewhere.t",)], "name string"))


@plans.query("q_logged_renames", "SELECT * FROM (VALUES ('table', 'app', 'old_a', 'new_b')) t(kind, \"schema\", old_name, new_name)")
def logged_renames(spark, sf_dir):
    """The log's entry replaces what equal shapes suggest (old_a to new_a)."""
    side = lambda *names: spark.createDataFrame([("table", "app", n, "shape") for n in names], "kind string, schema string, name string, shape string")
    log = spark.createDataFrame([("table", "app", "old_a", "new_b"), ("table", "app", "never", "new_a")], "kind string, schema string, old_name string, new_name string")
    return project.logged_renames(side("new_a", "new_b"), side("old_a"), log)


@plans.query("q_reverse_sync", "SELECT * FROM (VALUES ('a.sql', 'update', 1), ('b.sql', 'delete', 1), ('app/view/fresh.sql', 'create', 1)) t(file, action, changes)")
def reverse_sync(spark, sf_dir):
    now = spark.createDataFrame([("table", "app", "t", "2"), ("table", "app", "u", "1"), ("view", "app", "fresh", "9"), ("view", "app", "same", "5")], "kind string, schema string, name string, hash string")
    files = spark.createDataFrame([("table", "app", "t", "1", "a.sql"), ("table", "app", "u", "1", "a.sql"), ("view", "app", "lost", "3", "b.sql"), ("view", "app", "same", "5", "c.sql")], "kind string, schema string, name string, hash string, file string")
    return project.reverse_sync(now, files, allow_deletes=True)


@plans.query("q_baseline_rows", "SELECT * FROM (VALUES (0, 'customer', 'INSERT INTO app.customer (id, code) VALUES (1, ''tex'')'), (1, 'orders', 'INSERT INTO app.orders (id, paid) VALUES (1, true)'), (2, 'stamp', 'INSERT INTO app.stamp (note) VALUES (''text'')')) t(place, \"table\", statement)")
def baseline_rows(spark, sf_dir):
    rows = [("app", "orders", "id", 1, "int8", False, None, None, None), ("app", "orders", "paid", 2, "bool", False, None, None, None), ("app", "orders", "placed", 3, "timestamp", False, "now()", None, None), ("app", "customer", "id", 1, "int", False, None, None, None), ("app", "customer", "code", 2, "varchar(3)", False, None, None, None), ("app", "customer", "note", 3, "text", True, None, None, None), ("app", "stamp", "note", 1, "text", True, None, None, None)]
    return project.baseline_rows(spark.createDataFrame(rows, catalog.COLUMNS), [("orders", "customer")])


@plans.query("q_external_objects", "SELECT * FROM (VALUES ('table', 'app', 't', 1), ('table', 'shared', 'u', 0)) t(kind, \"schema\", name, emitted)")
def external_objects(spark, sf_dir):
    side = lambda *rows: spark.createDataFrame([("table", *r) for r in rows], "kind string, schema string, name string")
    every = project.with_external(side(("app", "t")), side(("shared", "u"), ("app", "t")))
    return every.select("kind", "schema", "name", (~F.col("is_external")).cast("int").alias("emitted")).filter("emitted = 1").unionByName(every.filter("is_external").select("kind", "schema", "name", F.lit(0).alias("emitted")))


@plans.query("q_script_variables", "SELECT * FROM (VALUES (1, 'use prod; grant to admin', ''), (2, 'drop $(Nothing); prod', '$(Nothing)')) t(n, script, undefined)")
def script_variables(spark, sf_dir):
    """Project, profile, command line: the last one wins."""
    values = project.variables({"Db": "dev", "Owner": "me"}, {"db": "test", "OWNER": "admin"}, {"DB": "prod"})
    rows = spark.createDataFrame([(1, "use $(db); grant to $(Owner)"), (2, "drop $(Nothing); $(DB)")], "n int, script string")
    return project.substitute(rows, values).withColumn("undefined", F.array_join("undefined", ","))


@plans.query("q_key_and_column_choice", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Different' ELSE 'Identical' END AS category, CASE WHEN o_orderkey % 7 = 0 THEN 'o_totalprice' ELSE '' END AS columns FROM orders")
def key_and_column_choice(spark, sf_dir):
    """The key is the primary one, else the first unique; generated columns and those of one side are left out."""
    t = Lake(spark, sf_dir).orders
    other = t.withColumn("o_totalprice", F.expr("if(o_orderkey % 7 = 0, o_totalprice + 1, o_totalprice)")).withColumn("o_clerk_copy", F.lit("x")).withColumn("o_orderstatus", F.lit("?"))
    key = compare.choose_key(None, [[], ["o_orderkey"], ["o_custkey", "o_orderdate"]])
    values = compare.choose_columns(t, other, key, generated=["o_orderstatus"])
    return compare.compare(t, other, key, values).select("o_orderkey", "category", F.array_join(F.transform(F.coalesce("diffs", F.array()), lambda d: d["column"]), ",").alias("columns"))


@plans.query("q_skipped_tables", "SELECT * FROM (VALUES ('only_s', 'only in source'), ('only_t', 'only in target'), ('keyless', 'no key')) t(\"table\", reason)")
def skipped_tables(spark, sf_dir):
    side = lambda *rows: spark.createDataFrame(list(rows), "table string, has_key boolean")
    return compare.skipped(side(("both", True), ("only_s", True), ("keyless", False)), side(("both", True), ("only_t", False), ("keyless", True)))


@plans.query("q_value_equality", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Different' ELSE 'Identical' END AS category FROM part")
def value_equality(spark, sf_dir):
    """Values are equal by type: 1.0 is 1.00, null is null and not a value."""
    t = Lake(spark, sf_dir).part
    one = t.select("p_partkey", F.lit("1.0").cast("decimal(9,1)").alias("a"), F.lit(None).cast("string").alias("b"))
    two = t.select("p_partkey", F.lit("1.00").cast("decimal(9,2)").alias("a"), F.when(F.col("p_partkey") % 3 == 0, "NULL").alias("b"))
    return compare.compare(one, two, ["p_partkey"]).select("p_partkey", "category")


@plans.query("q_table_order", "SELECT * FROM (VALUES (0, 'region'), (1, 'nation'), (2, 'customer'), (3, 'orders'), (4, 'part'), (5, 'supplier'), (6, 'lineitem')) t(place, name)")
def table_order(spark, sf_dir):
    """Parents before children by foreign keys, by name otherwise."""
    keys = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]
    order = compare.topological_order(["customer", "lineitem", "nation", "orders", "part", "region", "supplier"], keys)
    return spark.createDataFrame(list(enumerate(order)), "place int, name string")


@plans.query("q_canonical_text", "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, true)) t(n, same)")
def canonical_text(spark, sf_dir):
    """Blanks, cases and casts don't count outside of quotes; doing it again changes nothing."""
    rows = [(1, "SELECT  A\n FROM T", "select a from t"), (2, "((total >= 0))", "total>=0::numeric"), (3, "'X' = a", "'x' = a"), (4, "Status = 'New  One'", "status='New  One'")]
    t = spark.createDataFrame(rows, "n int, a string, b string").select("n", schema.canonical("a").alias("a"), schema.canonical("b").alias("b"))
    return t.select("n", ((F.col("a") == F.col("b")) & (schema.canonical("a") == F.col("a"))).alias("same"))


@plans.query("q_cycle_paths", "SELECT * FROM (VALUES ('a', 'a>b>c>a'), ('x', 'x>y>x')) t(component, path)")
def cycle_paths(spark, sf_dir):
    """The closed path of each cycle from its smallest member; components are those of a catalog."""
    edges = [("a", "b", "hard"), ("b", "c", "soft"), ("c", "a", "soft"), ("b", "a", "soft"), ("x", "y", "soft"), ("y", "x", "soft"), ("c", "x", "hard")]
    edges = [e for e in edges if e != ("b", "a", "soft")]
    members: dict[str, list[str]] = {}
    for r in graph.cycles(spark.createDataFrame(edges, "src string, dst string, kind string")).collect():
        members.setdefault(r.component, []).append(r.node)
    return spark.createDataFrame([(c, ">".join(graph.loop(m, [e[:2] for e in edges]))) for c, m in members.items()], "component string, path string")


@plans.query("q_change_ids", "SELECT sha256(concat('t', chr(31), kind, chr(31), name)) AS id, kind, name FROM (VALUES ('add_column', 'a'), ('drop_table', 'b')) v(kind, name)")
def change_ids(spark, sf_dir):
    """Ids from what a change says, and a selection by id and by kind."""
    rows = [("t", "add_column", "a"), ("t", "drop_table", "b"), ("t", "comment", "c"), ("t", "add_column", "d")]
    changes = schema.change_ids(spark.createDataFrame(rows, "object string, kind string, name string"), "object", "kind", "name")
    chosen = schema.content_hash(F.lit("t"), F.lit("add_column"), F.lit("d"))
    return changes.filter((F.col("kind") != "comment") & (F.col("id") != chosen)).select("id", "kind", "name")


@plans.query("q_row_policies", "SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_mktsegment = 'BUILDING') AND c_acctbal > 0")
def row_policies(spark, sf_dir):
    policies = [("clerk", "c_nationkey = 3"), ("public", "c_mktsegment = 'BUILDING'"), ("admin", "true")]
    return project.secured(Lake(spark, sf_dir).customer, "clerk", policies, [("public", "c_acctbal > 0")]).select("c_custkey")


@plans.query("q_statistics", "SELECT 'n_name' AS \"column\", 0::BIGINT AS nulls, count(DISTINCT n_name) AS \"distinct\", min(n_name) AS low, max(n_name) AS high FROM nation")
def statistics(spark, sf_dir):
    """ANALYZE of a table"""
    return project.statistics(Lake(spark, sf_dir).nation).filter("column = 'n_name'")


@plans.query("q_explain", "SELECT true AS scans, true AS pushed, false AS shuffles")
def explain(spark, sf_dir):
    """EXPLAIN of a filtered scan: the filter reaches the scan, and nothing is exchanged."""
    text = project.explain(Lake(spark, sf_dir).orders.filter("o_orderkey > 7").select("o_custkey"))
    return spark.createDataFrame([("Scan parquet" in text, "GreaterThan(o_orderkey,7)" in text, "Exchange" in text)], "scans boolean, pushed boolean, shuffles boolean")


@plans.query("q_procedural_block", "SELECT 55 AS total, 'odd' AS kind, 3 AS left_at")
def procedural_block(spark, sf_dir):
    """DECLARE, WHILE, IF, CASE, LOOP with LEAVE, and the result of the last query."""
    script = """
    BEGIN
      DECLARE total INT DEFAULT 0;
      DECLARE i INT DEFAULT 0;
      DECLARE n INT DEFAULT 0;
      DECLARE kind STRING;
      WHILE i < 10 DO
        SET i = i + 1;
        SET total = total + i;
      END WHILE;
      IF total % 2 = 1 THEN SET kind = 'odd'; ELSE SET kind = 'even'; END IF;
      again: LOOP
        SET n = n + 1;
        CASE WHEN n = 3 THEN LEAVE again; ELSE ITERATE again; END CASE;
      END LOOP again;
      SELECT total, kind, n AS left_at;
    END"""
    return project.run_block(spark, script)


@plans.query("q_sql_functions", "SELECT n_nationkey, n_regionkey * 2 + 1 AS a, n_regionkey * 2 + 10 AS b, n_nationkey + 5 AS c FROM nation")
def sql_functions(spark, sf_dir):
    """A function in SQL with a default and named arguments"""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quillon_scaled(x BIGINT, plus BIGINT DEFAULT 1) RETURNS BIGINT DETERMINISTIC RETURN x * 2 + plus")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quillon_add(x BIGINT, y BIGINT) RETURNS BIGINT RETURN x + y")
    return spark.sql("SELECT n_nationkey, quillon_scaled(n_regionkey) AS a, quillon_scaled(plus => 10, x => n_regionkey) AS b, quillon_add(n_nationkey, 5) AS c FROM {t}", t=Lake(spark, sf_dir).nation)


@plans.query("q_table_functions", "SELECT r_regionkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey >= 1")
def table_functions(spark, sf_dir):
    """A function that returns a table, called for each row"""
    Lake(spark, sf_dir).nation.createOrReplaceTempView("quillon_nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quillon_nations(k BIGINT) RETURNS TABLE (n_name STRING) RETURN SELECT n_name FROM quillon_nation WHERE n_regionkey = k")
    return spark.sql("SELECT r.r_regionkey, f.n_name FROM {t} r, LATERAL quillon_nations(r.r_regionkey) f WHERE r.r_regionkey >= 1", t=Lake(spark, sf_dir).region)


@plans.query("q_overloads", "SELECT l_orderkey, l_linenumber, l_quantity * 10 AS q, upper(l_returnflag) AS f, l_linenumber + 1 AS n FROM lineitem")
def overloads(spark, sf_dir):
    """One name for text, whole numbers and doubles: the argument's type decides, numbers widen."""
    f = project.Overloads("twist")
    f.add(["string"], F.upper)
    f.add(["bigint"], lambda x: x + 1)
    f.add(["double"], lambda x: x * 10)
    t = Lake(spark, sf_dir).lineitem
    return t.select("l_orderkey", "l_linenumber", f.call(t, "l_quantity").alias("q"), f.call(t, "l_returnflag").alias("f"), f.call(t, "l_linenumber").alias("n"))


@plans.query("q_views", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 2 GROUP BY n_regionkey")
def views(spark, sf_dir):
    """CREATE VIEW over a view"""
    Lake(spark, sf_dir).nation.createOrReplaceTempView("quillon_base")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW quillon_some AS SELECT * FROM quillon_base WHERE n_nationkey > 2")
    return spark.sql("SELECT n_regionkey, count(*) AS n FROM quillon_some GROUP BY n_regionkey")


@plans.query("q_recursive_view", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t")
def recursive_view(spark, sf_dir):
    """CREATE RECURSIVE VIEW"""
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW quillon_numbers AS WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
    return spark.sql("SELECT n, n * n AS sq FROM quillon_numbers")


@plans.query("q_field_access", "SELECT o_orderkey, o_custkey, o_totalprice, o_custkey + 1 AS next FROM orders")
def field_access(spark, sf_dir):
    """(r).f and (r).*"""
    rows = Lake(spark, sf_dir).orders.select("o_orderkey", F.struct("o_custkey", "o_totalprice").alias("r"))
    return rows.select("o_orderkey", "r.*", (F.col("r.o_custkey") + 1).alias("next"))


@plans.query("q_distinct_over", "SELECT DISTINCT o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders")
def distinct_over(spark, sf_dir):
    """DISTINCT comes after OVER"""
    return spark.sql("SELECT DISTINCT o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {t}", t=Lake(spark, sf_dir).orders)


@plans.query("q_bad_frame", "SELECT true AS refused")
def bad_frame(spark, sf_dir):
    """A frame that ends before it begins is an error when the query is analyzed."""
    from pyspark.errors import AnalysisException

    try:
        spark.sql("SELECT sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 1 PRECEDING) FROM {t}", t=Lake(spark, sf_dir).orders).schema  # noqa: B018
    except AnalysisException:
        return spark.createDataFrame([(True,)], "refused boolean")
    return spark.createDataFrame([(False,)], "refused boolean")


@plans.query("q_variadic", "SELECT n_nationkey, n_nationkey + n_regionkey AS two, n_nationkey + n_regionkey + n_nationkey AS three FROM nation")
def variadic(spark, sf_dir):
    """A function of as many numbers as are given"""
    f = project.Overloads("total")
    f.add(["bigint..."], lambda *xs: sum(xs[1:], xs[0]))
    t = Lake(spark, sf_dir).nation.withColumns({c: F.col(c).cast("bigint") for c in ("n_nationkey", "n_regionkey")})
    return t.select("n_nationkey", f.call(t, "n_nationkey", "n_regionkey").alias("two"), f.call(t, "n_nationkey", "n_regionkey", "n_nationkey").alias("three"))


@plans.query("q_user_operators", "SELECT o_orderkey, abs(o_orderkey - o_custkey) AS apart, o_orderstatus || '/' || o_orderstatus AS joined FROM orders")
def user_operators(spark, sf_dir):
    """One symbol for whole numbers and for text"""
    ops = project.Operators()
    ops.define("<->", ["bigint", "bigint"], lambda a, b: F.abs(a - b))
    ops.define("<->", ["string", "string"], lambda a, b: F.concat(a, F.lit("/"), b))
    t = Lake(spark, sf_dir).orders.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})
    return t.select("o_orderkey", ops.apply(t, "o_orderkey", "<->", "o_custkey").alias("apart"), ops.apply(t, "o_orderstatus", "<->", "o_orderstatus").alias("joined"))


@plans.query("q_external_rules", "SELECT * FROM (VALUES ('no-text', 'info', 'app.t', 'b'), ('short-name', 'warning', 'app.t', 'a'), ('short-name', 'warning', 'app.t', 'b')) t(rule, severity, object, detail)")
def external_rules(spark, sf_dir):
    where = F.concat_ws(".", "schema", "table").alias("object")
    finding = lambda name, level, rows: rows.select(F.lit(name).alias("rule"), F.lit(level).alias("severity"), where, F.col("name").alias("detail"))
    rules = [lambda columns, **_: finding("no-text", "info", columns.filter("type = 'text'")), lambda columns, **_: finding("short-name", "warning", columns.filter("length(name) < 2"))]
    columns = spark.createDataFrame([("app", "t", "a", 1, "int", True, None, None, None), ("app", "t", "b", 2, "text", True, None, None, None), ("app", "t", "long", 3, "int", True, None, None, None)], catalog.COLUMNS)
    return project.run_rules(rules, columns=columns, statements=columns.limit(0))


@plans.query("q_procedural_function", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g FROM part")
def procedural_function(spark, sf_dir):
    """A function with a loop, as an Arrow batch function"""
    @F.pandas_udf("bigint")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        while (b > 0).any():
            a, b = a.where(b == 0, b), (a % b.where(b > 0, 1)).where(b > 0, 0)
        return a

    return Lake(spark, sf_dir).part.select("p_partkey", common(F.col("p_partkey").cast("bigint"), F.col("p_size").cast("bigint")).alias("g"))


@plans.query("q_call_with_arguments", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'F'")
def call_with_arguments(spark, sf_dir):
    """CALL and EXECUTE ... USING: a statement made from text, with arguments bound to it"""
    Lake(spark, sf_dir).orders.createOrReplaceTempView("quillon_orders")
    script = """
    BEGIN
      DECLARE wanted STRING DEFAULT 'F';
      DECLARE statement STRING DEFAULT 'SELECT count(*) AS n, max(o_totalprice) AS most FROM quillon_orders WHERE o_orderstatus = ?';
      EXECUTE IMMEDIATE statement USING wanted;
    END"""
    return project.run_block(spark, script)
