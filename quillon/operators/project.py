"""What a project of SQL files needs around a comparison: renames that were logged, changes back to files, rows to test with, variables, policies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.compare import topological_order
from quillon.operators.schema import renames, type_base, type_length


def logged_renames(source: DataFrame, target: DataFrame, log: DataFrame) -> DataFrame:
    """Renames by a log (kind, schema, old_name, new_name); only if it gives none, those that shapes suggest.

    An entry counts where the target still has the old name and the source has the new one.
    """
    new = source.select("kind", "schema", F.col("name").alias("new_name"))
    old = target.select("kind", "schema", F.col("name").alias("old_name"))
    told = log.join(new, ["kind", "schema", "new_name"], "left_semi").join(old, ["kind", "schema", "old_name"], "left_semi").select("kind", "schema", "old_name", "new_name").distinct()
    guessed = renames(source, target).crossJoin(F.broadcast(told.agg(F.count("*").alias("told")))).filter("told = 0").drop("told")  # one row
    return told.unionByName(guessed)


def reverse_sync(database: DataFrame, project: DataFrame, allow_deletes: bool = False) -> DataFrame:
    """Drift from the files' side: what to do with each file so that the project is as the database.

    ``database`` has (kind, schema, name, hash), ``project`` also ``file``. A changed
    or new object updates its file (new ones get ``schema/kind/name.sql``); a file
    whose objects are all gone is deleted if that is allowed, else updated.
    """
    key = ["kind", "schema", "name"]
    both = project.select(*key, F.col("hash").alias("was"), "file").join(database.select(*key, F.col("hash").alias("now")), key, "full")
    state = F.when(F.col("was").isNull() & F.col("file").isNull(), "create").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "update").otherwise("same")
    place = F.coalesce("file", F.concat_ws("/", "schema", "kind", F.concat("name", F.lit(".sql"))))
    files = both.select(place.alias("file"), state.alias("state")).groupBy("file").agg(F.collect_set("state").alias("states"), F.count(F.when(F.col("state") != "same", 1)).alias("changes"))
    action = F.when(F.size("states") == F.size(F.filter("states", lambda s: s == "create")), "create").when((F.size("states") == 1) & F.array_contains("states", "gone") & F.lit(allow_deletes), "delete").otherwise("update")
    return files.filter("changes > 0").select("file", action.alias("action"), F.col("changes").cast("int").alias("changes"))


#: A literal for each family of types.
LITERALS = {"smallint": "1", "integer": "1", "bigint": "1", "numeric": "1.0", "real": "1.0", "double precision": "1.0", "boolean": "true", "date": "'2000-01-01'", "timestamp": "'2000-01-01 00:00:00'", "timestamp with time zone": "'2000-01-01 00:00:00+00'", "time": "'00:00:00'", "uuid": "'00000000-0000-0000-0000-000000000001'", "json": "'{}'", "jsonb": "'{}'", "bytea": "'\\x00'", "interval": "'1 day'"}


def literal_for(kind) -> Column:
    """A literal of a type; text as long as its length allows."""
    table = F.create_map(*(F.lit(x) for pair in LITERALS.items() for x in pair))
    text = F.concat(F.lit("'"), F.substring(F.lit("text"), F.lit(1), F.least(F.coalesce(type_length(kind), F.lit(4)), F.lit(4))), F.lit("'"))
    array = F.when(F.col(kind).endswith("[]") if isinstance(kind, str) else kind.endswith("[]"), "'{}'")
    return F.coalesce(array, F.try_element_at(table, type_base(kind)), text)


def baseline_rows(columns: DataFrame, references: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One INSERT for each table, parents first: every column that needs a value gets a literal of its type.

    Columns with a default, an identity or a generated expression are left out, and
    nullable ones unless nothing else is left. ``references`` are (child, parent).
    """
    needed = columns.filter("default is null and generated is null and identity is null").withColumn("value", literal_for("type"))
    some = needed.groupBy("schema", "table").agg(F.array_sort(F.collect_list(F.when(~F.col("nullable"), F.struct("ordinal", "name", "value")))).alias("must"), F.array_sort(F.collect_list(F.struct("ordinal", "name", "value"))).alias("all"))
    rows = columns.select("schema", "table").distinct().join(some, ["schema", "table"], "left")
    kept = F.when(F.size("must") > 0, F.col("must")).otherwise(F.slice("all", 1, 1))
    names, values = F.array_join(F.transform(kept, lambda c: c["name"]), ", "), F.array_join(F.transform(kept, lambda c: c["value"]), ", ")
    head = F.concat(F.lit("INSERT INTO "), "schema", F.lit("."), "table")
    statement = F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(head, F.lit(" ("), names, F.lit(") VALUES ("), values, F.lit(")"))).otherwise(F.concat(head, F.lit(" DEFAULT VALUES")))
    tables = sorted(r["table"] for r in columns.select("table").distinct().collect())  # a catalog's names
    places = columns.sparkSession.createDataFrame([(t, i) for i, t in enumerate(topological_order(tables, references))], "table string, place int")
    return rows.join(places, "table").select("place", "table", statement.alias("statement"))


def with_external(objects: DataFrame, external: DataFrame) -> DataFrame:
    """Objects of this project and those of others, marked ``is_external``: they resolve but are neither emitted nor checked."""
    return objects.withColumn("is_external", F.lit(False)).unionByName(external.join(objects.select("kind", "schema", "name"), ["kind", "schema", "name"], "left_anti").withColumn("is_external", F.lit(True)))


def emitted(objects: DataFrame) -> DataFrame:
    return objects.filter(~F.col("is_external")).drop("is_external")


VARIABLE = r"\$\(([A-Za-z_]\w*)\)"


def variables(*levels: Mapping[str, str]) -> dict[str, str]:
    """Values by name; a later level (project, profile, command line) goes over an earlier one. Names have any case."""
    out: dict[str, str] = {}
    for level in levels:
        out |= {k.lower(): v for k, v in level.items()}
    return out


def substitute(scripts: DataFrame, values: Mapping[str, str], column: str = "script") -> DataFrame:
    """Scripts with $(name) replaced; ``undefined`` lists the names that have no value, which stay as they are."""
    table = F.create_map(*(F.lit(x) for pair in (values or {"": ""}).items() for x in pair))
    text = F.col(column)
    marks = F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(0))
    value = lambda m: F.coalesce(F.try_element_at(table, F.lower(F.substring(m, F.lit(3), F.length(m) - 3))), m)
    made = F.array_join(F.transform(F.arrays_zip(F.split(text, VARIABLE, -1).alias("p"), marks.alias("m")), lambda z: F.concat(z["p"], F.coalesce(value(z["m"]), F.lit("")))), "")
    missing = F.array_distinct(F.filter(marks, lambda m: value(m) == m))
    return scripts.withColumn(column, made).withColumn("undefined", missing)


def secured(df: DataFrame, role: str, policies: Sequence[tuple[str, str]], restrictive: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Row-level security: rows that a policy (role or 'public', predicate) of the role lets through.

    Policies are joined by OR, restrictive ones by AND; without any policy no row is seen.
    """
    mine = [p for r, p in policies if r in (role, "public")]
    if not mine:
        return df.limit(0)
    seen = F.coalesce(F.expr(" or ".join(f"({p})" for p in mine)), F.lit(False))
    for r, p in restrictive:
        if r in (role, "public"):
            seen = seen & F.coalesce(F.expr(p), F.lit(False))
    return df.filter(seen)


def statistics(df: DataFrame) -> DataFrame:
    """ANALYZE: for each column its nulls, different values (approximately) and extremes as text."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), F.approx_count_distinct(c, 0.02).alias("distinct"), F.min(F.col(c).cast("string")).alias("low"), F.max(F.col(c).cast("string")).alias("high")) for c in df.columns]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """EXPLAIN: the plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


class Overloads:
    """Functions of one name by their argument types; the cheapest widening of numbers wins, a tie is an error."""

    WIDTHS = ("smallint", "int", "bigint", "decimal", "float", "double")

    def __init__(self, name: str) -> None:
        self.name, self.known = name, {}

    def add(self, types: Sequence[str], function) -> None:
        self.known[tuple(types)] = function

    def _cost(self, given: Sequence[str], wanted: Sequence[str]) -> int | None:
        if wanted and wanted[-1].endswith("..."):  # VARIADIC: as many of the last type as are given, at least one
            fixed = list(wanted[:-1])
            wanted = [*fixed, *[wanted[-1].removesuffix("...")] * max(1, len(given) - len(fixed))]
        if len(given) != len(wanted):
            return None
        total = 0
        for g, w in zip(given, wanted, strict=True):
            if g != w and not (g in self.WIDTHS and w in self.WIDTHS and self.WIDTHS.index(g) < self.WIDTHS.index(w)):
                return None
            total += 0 if g == w else self.WIDTHS.index(w) - self.WIDTHS.index(g)
        return total

    def resolve(self, given: Sequence[str]):
        costs = sorted((c, str(t), f) for t, f in self.known.items() if (c := self._cost(given, t)) is not None)
        if not costs:
            raise LookupError(f"function {self.name}({', '.join(given)}) does not exist")
        if len(costs) > 1 and costs[0][0] == costs[1][0]:
            raise LookupError(f"function {self.name}({', '.join(given)}) is not unique")
        return costs[0][2]

    def call(self, df: DataFrame, *columns: str) -> Column:
        """The call on columns of a frame, by their types there."""
        types = dict(df.dtypes)
        return self.resolve([re.sub(r"\(.*", "", types[c]) for c in columns])(*(F.col(c) for c in columns))


class Operators:
    """User operators: a symbol and its argument types name a function, which an index or a sort may use by its name."""

    def __init__(self) -> None:
        self.known: dict[str, Overloads] = {}

    def define(self, symbol: str, types: Sequence[str], function) -> None:
        self.known.setdefault(symbol, Overloads(symbol)).add(types, function)

    def apply(self, df: DataFrame, left: str, symbol: str, right: str) -> Column:
        return self.known[symbol].call(df, left, right)


def run_rules(rules: Sequence, **tables: DataFrame) -> DataFrame:
    """Rules from outside: each takes the metadata tables by name and gives findings (rule, severity, object, detail)."""
    found = None
    for rule in rules:
        one = rule(**tables).select("rule", "severity", "object", "detail")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no rules")
    return found


def run_block(spark: SparkSession, script: str) -> DataFrame:
    """A procedural block (DECLARE, SET, IF, CASE, WHILE, LOOP, FOR, LEAVE, ITERATE, SIGNAL, handlers) as SQL scripting.

    DO and CALL are blocks without and with arguments; the last query is the result.
    """
    return spark.sql(script)
