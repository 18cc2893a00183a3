"""Schema metadata as tables: comparison, hashing, renames, risk and rules.

Metadata tables (all names are strings):
  columns      schema, table, name, ordinal, type, nullable, default, generated, identity
  constraints  schema, table, name, kind (p, u, f, c), columns, ref_table, ref_columns, on_delete, on_update, expression, nulls_not_distinct, include
  indexes      schema, table, name, columns, is_unique, method, predicate
  objects      kind, schema, name, body
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = "\u001f"

#: Type names that mean the same.
ALIASES = {"int": "integer", "int4": "integer", "int2": "smallint", "int8": "bigint", "decimal": "numeric", "float4": "real", "float8": "double precision", "float": "double precision", "bool": "boolean", "varchar": "character varying", "char": "character", "bpchar": "character", "timestamptz": "timestamp with time zone", "timestamp without time zone": "timestamp", "timetz": "time with time zone", "varbit": "bit varying", "serial": "integer", "serial4": "integer", "bigserial": "bigint", "serial8": "bigint", "smallserial": "smallint"}
INTEGERS = {"smallint": 1, "integer": 2, "bigint": 3}


def _lookup(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def type_base(kind) -> Column:
    """The canonical name of a type without length and array marks."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(kind), r"\([^)]*\)|\[\]", ""), r"\s+", " "))
    return F.coalesce(F.try_element_at(_lookup(ALIASES), bare), bare)


def type_name(kind) -> Column:
    """The canonical name of a type with its length and array marks."""
    low = F.lower(kind)
    return F.concat(type_base(kind), F.regexp_replace(F.regexp_extract(low, r"\([^)]*\)", 0), r"\s+", ""), F.array_join(F.regexp_extract_all(low, F.lit(r"\[\]"), F.lit(0)), ""))


def type_length(kind) -> Column:
    return F.regexp_extract(kind, r"\((\d+)", 1).try_cast("int")


def canonical(text) -> Column:
    """SQL text in lower case with single spaces, outside of quotes; casts and outer brackets go.

    Quoted pieces are split off first and put back as they were.
    """
    c = F.col(text) if isinstance(text, str) else text
    parts = F.regexp_extract_all(c, F.lit(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[^'\"]+"), F.lit(0))

    def plain(p: Column) -> Column:
        p = F.lower(p)
        p = F.regexp_replace(p, r"::\s*[a-z_][a-z0-9_]*(?: (?:varying|precision))?(?:\(\d+(?:,\s*\d+)?\))?(?:\[\])?", "")
        return F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r" ?([(),=<>+*/-]) ?", "$1")

    joined = F.trim(F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("'")) | F.startswith(p, F.lit('"')), p).otherwise(plain(p))), ""))
    inside = "[^()]*+"
    for _ in range(4):  # balanced brackets, to this depth
        inside = rf"(?:[^()]|\({inside}\))*+"
    peel = lambda e: F.regexp_replace(e, rf"^\(({inside})\)$", "$1")
    return F.trim(peel(peel(peel(F.regexp_replace(joined, ";+$", "")))))


def content_hash(*fields) -> Column:
    """SHA-256 of the fields joined by a separator, null as the empty text."""
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit("")) for f in fields)), 256)


def table_shape(columns: DataFrame) -> DataFrame:
    """``schema``, ``table`` and ``shape``: a hash of ordered columns without the table's name."""
    rows = columns.withColumn("part", F.struct("ordinal", F.lower("name").alias("name"), type_name(F.col("type")).alias("type"), "nullable"))
    return rows.groupBy("schema", "table").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("part"))), 256).alias("shape"))


def diff_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Changes of columns: (schema, table, name, change), change in add, drop, alter and the fields that differ."""
    key = ["schema", "table", "name"]
    part = lambda df: df.select(*(F.lower(k).alias(k) for k in key), F.struct(type_name(F.col("type")).alias("type"), F.col("nullable").alias("nullable"), canonical(F.coalesce("default", F.lit(""))).alias("default"), canonical(F.coalesce("generated", F.lit(""))).alias("generated"), F.coalesce("identity", F.lit("")).alias("identity")).alias("v"))
    both = part(source).withColumnRenamed("v", "s").join(part(target).withColumnRenamed("v", "t"), key, "full")
    fields = F.filter(F.array(*(F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"t.{f}")), F.lit(f)) for f in ("type", "nullable", "default", "generated", "identity"))), lambda f: f.isNotNull())
    change = F.when(F.col("t").isNull(), "add").when(F.col("s").isNull(), "drop").when(F.size(fields) > 0, "alter")
    return both.select(*key, change.alias("change"), F.when(change == "alter", F.array_join(fields, ",")).otherwise("").alias("fields")).filter("change is not null")


def diff_order(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables with the same columns in another order."""
    names = lambda df, to: df.groupBy("schema", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.lower("name").alias("n")))), lambda c: c["n"]).alias(to))
    both = names(source, "s").join(names(target, "t"), ["schema", "table"])
    return both.filter((F.array_sort("s") == F.array_sort("t")) & (F.col("s") != F.col("t"))).select("schema", "table")


def signature(kind: str) -> Column:
    """What makes two constraints of a kind (p, u, f, c) or indexes (i) equal."""
    low = lambda c: F.transform(F.col(c), lambda x: F.lower(x))
    text = {
        "p": lambda: F.array_join(low("columns"), ","),
        "u": lambda: F.concat_ws("|", F.array_join(F.array_sort(low("columns")), ","), F.coalesce(F.col("nulls_not_distinct"), F.lit(False)).cast("string"), F.array_join(F.coalesce(low("include"), F.array().cast("array<string>")), ",")),
        "c": lambda: canonical(F.coalesce("expression", F.lit(""))),
        "f": lambda: F.concat_ws("|", F.array_join(low("columns"), ","), F.lower("ref_table"), F.array_join(low("ref_columns"), ","), *(F.coalesce(F.nullif(F.lower(a), F.lit("no action")), F.lit("")) for a in ("on_delete", "on_update"))),
        "i": lambda: F.concat_ws("|", F.coalesce("is_unique", F.lit(False)).cast("string"), F.coalesce("method", F.lit("btree")), F.array_join(F.transform(F.col("columns"), lambda x: F.regexp_replace(F.lower(x), r"\s+asc(?:\s+nulls last)?$|(?<!desc)\s+nulls last$", "")), ","), canonical(F.coalesce("predicate", F.lit("")))),
    }
    return text[kind]()


def diff_constraints(source: DataFrame, target: DataFrame, kind: str) -> DataFrame:
    """Constraints of a kind only on one side by signature: (schema, table, signature, change)."""
    part = lambda df: df.filter(F.col("kind") == kind).select(F.lower("schema").alias("schema"), F.lower("table").alias("table"), signature(kind).alias("signature")).distinct()
    s, t = part(source), part(target)
    key = ["schema", "table", "signature"]
    return s.join(t, key, "left_anti").withColumn("change", F.lit("add")).unionByName(t.join(s, key, "left_anti").withColumn("change", F.lit("drop")))


def diff_objects(source: DataFrame, target: DataFrame, key: Sequence[str] = ("kind", "schema", "name"), drops: bool = False) -> DataFrame:
    """Objects created, changed (by canonical body) or, if allowed, dropped; functions never are."""
    part = lambda df, to: df.select(*(F.lower(k).alias(k) for k in key), canonical("body").alias(to))
    both = part(source, "s").join(part(target, "t"), list(key), "full")
    change = F.when(F.col("t").isNull(), "create").when(F.col("s").isNull(), F.when(F.lit(drops) & (F.col("kind") != "function"), "drop")).when(F.col("s") != F.col("t"), "alter")
    return both.select(*key, change.alias("change")).filter("change is not null")


def renames(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of (kind, schema, name, shape) rows that are unmatched by name and equal by shape.

    Paired in name order; ``old_name`` is the target's.
    """
    key = ["kind", "schema", "name"]
    fresh, gone = source.join(target.select(*key), key, "left_anti"), target.join(source.select(*key), key, "left_anti")
    by = Window.partitionBy("kind", "schema", "shape").orderBy("name")
    a = fresh.withColumn("nth", F.row_number().over(by))
    b = gone.withColumn("nth", F.row_number().over(by)).withColumnRenamed("name", "old_name")
    return a.join(b, ["kind", "schema", "shape", "nth"]).select("kind", "schema", "old_name", F.col("name").alias("new_name"))


def risk(changes: DataFrame) -> DataFrame:
    """Changes (change, old_type, new_type, nullable, has_default) with ``risk`` and ``rewrites``.

    Integers that widen are a warning and those that narrow lose data, as does a
    shorter length of the same type; other changes of the type, and any of an array's, are dangerous. A
    change of length alone doesn't rewrite the table.
    """
    old, new = type_base(F.col("old_type")), type_base(F.col("new_type"))
    ranks = _lookup(INTEGERS)
    a, b = F.try_element_at(ranks, old), F.try_element_at(ranks, new)
    length = lambda c: F.coalesce(type_length(F.col(c)), F.lit(1 << 30))
    shorter = length("new_type") - length("old_type")
    is_ = lambda *names: F.col("change").isin(*names)
    same = type_name(F.col("old_type")) == type_name(F.col("new_type"))
    typed = (
        F.when(same, "Safe")
        .when(F.concat_ws(" ", "old_type", "new_type").contains("[]"), "Dangerous")
        .when(a > b, "DataLoss")
        .when(a < b, "Warning")
        .when((old == new) & (shorter < 0), "DataLoss")
        .when((old == new) & (shorter > 0), "Warning")
        .when(old == new, "Safe")
        .otherwise("Dangerous")
    )
    kind = (
        F.when(is_("drop_table", "drop_column", "drop_sequence"), "DataLoss")
        .when(is_("add_column"), F.when(F.col("nullable"), "Safe").when(F.col("has_default"), "Warning").otherwise("Dangerous"))
        .when(is_("alter_type"), typed)
        .when(is_("set_not_null", "create_index", "add_foreign_key", "add_primary_key", "add_unique", "add_check"), "Warning")
        .when(is_("create_schema", "create_table", "create_view", "drop_not_null", "set_default"), "Safe")
        .otherwise("Unknown")
    )
    return changes.withColumns({"risk": kind, "rewrites": is_("alter_type") & ~same & (old != new)})


def gate(changes: DataFrame, allow_data_loss: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Changes (change, risk) that pass the gates."""
    kept = changes if allow_data_loss else changes.filter("risk <> 'DataLoss'")
    kept = kept.filter(F.col("change").isin(*include)) if include else kept
    return kept.filter(~F.col("change").isin(*exclude)) if exclude else kept


def change_ids(changes: DataFrame, *fields: str) -> DataFrame:
    return changes.withColumn("id", content_hash(*fields))


def lighter_locks(steps: DataFrame) -> DataFrame:
    """Steps (ordinal, kind, named, statement) split so that long locks are short.

    Index builds become concurrent; a named foreign key or check is added
    unvalidated and validated later. ``part`` orders the pieces.
    """
    valid = F.col("kind").isin("foreign_key", "check") & F.col("named")
    pieces = F.when(F.col("kind") == "index", F.array(F.regexp_replace("statement", r"(?i)\bINDEX\b", "INDEX CONCURRENTLY"))).when(valid, F.array(F.concat("statement", F.lit(" NOT VALID")), F.concat(F.lit("VALIDATE "), F.col("statement")))).otherwise(F.array("statement"))
    return steps.select("ordinal", "kind", F.posexplode(pieces).alias("part", "statement"))


def uncovered_foreign_keys(constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """Foreign keys whose columns no index, key or unique constraint of the table starts with, in any order."""
    low = lambda c: F.transform(F.col(c), lambda x: F.lower(x))
    covers = indexes.filter("predicate is null").select("schema", "table", low("columns").alias("have")).unionByName(constraints.filter("kind in ('p', 'u')").select("schema", "table", low("columns").alias("have")))
    fks = constraints.filter("kind = 'f'").select("schema", "table", "name", low("columns").alias("want"))
    good = fks.join(covers, ["schema", "table"]).filter("size(have) >= size(want) and size(array_except(slice(have, 1, size(want)), want)) = 0 and size(array_except(want, slice(have, 1, size(want)))) = 0")
    return fks.join(good.select("schema", "table", "name").distinct(), ["schema", "table", "name"], "left_anti").select("schema", "table", "name")


def redundant_indexes(indexes: DataFrame) -> DataFrame:
    """Indexes that repeat another (duplicate) or are a strict prefix of a wider whole-table one (prefix)."""
    low = indexes.select("schema", "table", "name", F.transform("columns", lambda x: F.lower(x)).alias("cols"), F.coalesce("predicate", F.lit("")).alias("predicate"), "is_unique")
    a, b = low, low.select(F.col("schema").alias("s2"), F.col("table").alias("t2"), F.col("name").alias("other"), F.col("cols").alias("cols2"), F.col("predicate").alias("p2"))
    pairs = a.join(b, (F.col("schema") == F.col("s2")) & (F.col("table") == F.col("t2")) & (F.col("name") != F.col("other")))
    same = pairs.filter("cols = cols2 and predicate = p2 and name > other").groupBy("schema", "table", "name").agg(F.min("other").alias("other")).withColumn("rule", F.lit("duplicate"))
    wide = pairs.filter("not is_unique and predicate = '' and p2 = '' and size(cols) < size(cols2) and slice(cols2, 1, size(cols)) = cols").groupBy("schema", "table", "name").agg(F.min("other").alias("other")).withColumn("rule", F.lit("prefix"))
    return same.unionByName(wide.join(same.select("schema", "table", "name"), ["schema", "table", "name"], "left_anti"))


#: Rules over columns and tables: name, level, what is found, as SQL over a columns row or a table's facts.
COLUMN_RULES = (
    ("money-type", "warning", "lower(type) = 'money'"),
    ("char-type", "warning", "lower(type) rlike '^char(acter)?\\\\(' "),
    ("timestamp-without-zone", "info", "lower(type) in ('timestamp', 'timestamp without time zone')"),
    ("serial-type", "info", "lower(type) rlike '^(small|big)?serial[248]?$'"),
    ("upper-case-name", "info", "name <> lower(name)"),
    ("json-not-jsonb", "info", "lower(type) = 'json'"),
    ("reserved-name", "warning", "lower(name) in ('user', 'order', 'group', 'table', 'select', 'default')"),
)
#: Rules over the text of a file's statements (schema, name, statement).
STATEMENT_RULES = (
    ("select-star", "warning", "statement rlike '(?i)\\\\bselect\\\\s+(\\\\w+\\\\.)?\\\\*'"),
    ("delete-without-where", "error", "statement rlike '(?i)^\\\\s*delete\\\\s+from\\\\b' and not statement rlike '(?i)\\\\bwhere\\\\b'"),
    ("update-without-where", "error", "statement rlike '(?i)^\\\\s*update\\\\b' and not statement rlike '(?i)\\\\bwhere\\\\b'"),
    ("not-in-subquery", "warning", "statement rlike '(?i)\\\\bnot\\\\s+in\\\\s*\\\\(\\\\s*select\\\\b'"),
    ("leading-wildcard", "info", "statement rlike '(?i)\\\\blike\\\\s+''%'"),
    ("order-by-ordinal", "info", "statement rlike '(?i)\\\\border\\\\s+by\\\\s+\\\\d'"),
    ("comma-join", "info", "statement rlike '(?i)\\\\bfrom\\\\s+\\\\w+(\\\\.\\\\w+)?(\\\\s+\\\\w+)?\\\\s*,\\\\s*\\\\w+'"),
    ("truncate-cascade", "warning", "statement rlike '(?i)^\\\\s*truncate\\\\b.*\\\\bcascade\\\\b'"),
    ("grant-to-public", "warning", "statement rlike '(?i)^\\\\s*grant\\\\b.*\\\\bto\\\\s+public\\\\b'"),
    ("null-comparison", "warning", "statement rlike '(?i)(=|<>|!=)\\\\s*null\\\\b'"),
)


def lint(columns: DataFrame, constraints: DataFrame, indexes: DataFrame, statements: DataFrame) -> DataFrame:
    """Findings (rule, severity, object, detail) of all rules, as one union of filters."""
    parts = [columns.filter(test).select(F.lit(rule).alias("rule"), F.lit(level).alias("severity"), F.concat_ws(".", "schema", "table").alias("object"), F.col("name").alias("detail")) for rule, level, test in COLUMN_RULES]
    parts += [statements.filter(test.replace("''%", "\\'%")).select(F.lit(rule).alias("rule"), F.lit(level).alias("severity"), F.concat_ws(".", "schema", "name").alias("object"), F.lit("").alias("detail")) for rule, level, test in STATEMENT_RULES]
    tables = columns.select("schema", "table").distinct()
    where = F.concat_ws(".", "schema", "table")
    no_key = tables.join(constraints.filter("kind = 'p'").select("schema", "table"), ["schema", "table"], "left_anti")
    parts.append(no_key.select(F.lit("no-primary-key").alias("rule"), F.lit("warning").alias("severity"), where.alias("object"), F.lit("").alias("detail")))
    parts.append(uncovered_foreign_keys(constraints, indexes).select(F.lit("foreign-key-not-covered").alias("rule"), F.lit("warning").alias("severity"), where.alias("object"), F.col("name").alias("detail")))
    parts.append(constraints.filter("kind = 'f' and on_delete is null and on_update is null").select(F.lit("foreign-key-without-action").alias("rule"), F.lit("info").alias("severity"), where.alias("object"), F.col("name").alias("detail")))
    parts.append(constraints.filter("kind in ('f', 'c', 'u') and name is null").select(F.lit("unnamed-constraint").alias("rule"), F.lit("info").alias("severity"), where.alias("object"), F.col("kind").alias("detail")))
    parts.append(redundant_indexes(indexes).select(F.concat(F.lit("index-"), F.col("rule")).alias("rule"), F.lit("warning").alias("severity"), where.alias("object"), F.col("name").alias("detail")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def configure(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Findings under a table (rule, enabled, severity, source) where command line beats file beats default."""
    w = Window.partitionBy("rule").orderBy(F.when(F.col("source") == "cli", 0).when(F.col("source") == "file", 1).otherwise(2))
    best = config.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("rule", "enabled", F.col("severity").alias("asked"))
    joined = findings.join(best, "rule", "left").filter("coalesce(enabled, true)")
    return joined.select("rule", F.coalesce("asked", "severity").alias("severity"), "object", "detail")


#: The first version of the server that has a feature, by a pattern of its text.
FEATURES = (("merge", 15, r"(?i)^\s*merge\s+into"), ("merge-returning", 17, r"(?is)^\s*merge\s+into.*\breturning\b"), ("merge-by-source", 17, r"(?is)^\s*merge\s+into.*\bby\s+source\b"), ("nulls-not-distinct", 15, r"(?i)nulls\s+not\s+distinct"), ("json-table", 17, r"(?i)\bjson_table\s*\("), ("json-functions", 17, r"(?i)\bjson_(query|value|exists)\s*\("), ("json-constructors", 16, r"(?i)\bjson_(array|object|arrayagg|objectagg)\s*\("), ("is-json", 16, r"(?i)\bis\s+(not\s+)?json\b"))


def version_gate(statements: DataFrame, major: int) -> DataFrame:
    """Statements (name, statement) that use what a server of this version lacks."""
    tests = F.array(*(F.when(F.col("statement").rlike(p), F.struct(F.lit(n).alias("feature"), F.lit(v).alias("needs"))) for n, v, p in FEATURES))
    found = statements.select("name", F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("f"))
    return found.select("name", "f.feature", "f.needs").filter(F.col("needs") > major)
