"""JSON elements, paths, changes, records and constructors over a small object made of each nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import pgjson as J
from quillon.plans.base import Lake, Plans

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles

_TEXT = """'{"id":' || n_nationkey || ',"name":"' || n_name || '","tags":["a","' || n_regionkey || '"],"in":{"r":' || n_regionkey || ',"z":null}}'"""
_FROM = f"(SELECT n_nationkey, n_regionkey, n_name, {_TEXT} AS j FROM nation)"


def rows(spark, sf_dir):
    return Lake(spark, sf_dir).nation.select("n_nationkey", "n_regionkey", "n_name", F.expr(_TEXT.replace("'{", "'{")).alias("j"))


@plans.query("q_json_array_elements", f"""SELECT n_nationkey, unnest(['"a"', '"' || n_regionkey || '"']) AS e, unnest(['a', CAST(n_regionkey AS VARCHAR)]) AS t FROM {_FROM}""")
def json_array_elements(spark, sf_dir):
    """json(b)_array_elements and json(b)_array_elements_text"""
    t = J.get("j", "tags")
    both = F.arrays_zip(F.transform(J.elements_text(t), J.to_jsonb).alias("e"), J.elements_text(t).alias("t"))
    return rows(spark, sf_dir).select("n_nationkey", F.explode(both).alias("x")).select("n_nationkey", "x.e", "x.t")


@plans.query("q_json_each", f"SELECT n_nationkey, unnest(['id', 'name', 'tags', 'in']) AS k, unnest([CAST(n_nationkey AS VARCHAR), n_name, '[\"a\",\"' || n_regionkey || '\"]', '{{\"r\":' || n_regionkey || ',\"z\":null}}']) AS v FROM {_FROM}")
def json_each(spark, sf_dir):
    """json(b)_each_text; json(b)_each gives the same keys"""
    return rows(spark, sf_dir).select("n_nationkey", F.explode(J.each_text("j")).alias("k", "v"))


@plans.query("q_json_object_keys", f"SELECT n_nationkey, unnest(['id', 'name', 'tags', 'in']) AS k FROM {_FROM}")
def json_object_keys(spark, sf_dir):
    """json(b)_object_keys"""
    return rows(spark, sf_dir).select("n_nationkey", F.explode(J.keys("j")).alias("k"))


@plans.query("q_json_path_queries", f"""SELECT n_nationkey, '["a","' || n_regionkey || '"]' AS a, CAST(n_regionkey AS VARCHAR) AS f, n_regionkey >= 2 AS m, n_nationkey > 3 AS x, CASE WHEN n_nationkey > 3 THEN '[' || n_nationkey || ']' ELSE '[]' END AS q, '["a","' || n_regionkey || '"]' AS tz, true AS etz, n_regionkey = 1 AS mtz, CAST(n_nationkey AS VARCHAR) AS ftz FROM {_FROM}""")
def json_path_queries(spark, sf_dir):
    """jsonb_path_query, _array, _first, _match, _exists and their _tz forms"""
    return rows(spark, sf_dir).select(
        "n_nationkey", J.path_query_array("j", "$.tags[*]").alias("a"), J.path_query_first("j", "$.in.r").alias("f"), J.path_match("j", "$.in.r >= 2").alias("m"), J.path_exists("j", "$.id ? (@ > 3)").alias("x"),
        J.path_query_array("j", "$.id ? (@ > 3)").alias("q"), J.path_query_array_tz("j", "$.tags[*]").alias("tz"), J.path_exists_tz("j", "$.name").alias("etz"), J.path_match_tz("j", "$.in.r == 1").alias("mtz"), J.path_query_first_tz("j", "$.id").alias("ftz"),
    )


@plans.query("q_json_value_and_query", f"""SELECT n_nationkey, n_name AS v, 'none' AS d, '["a","' || n_regionkey || '"]' AS q, '[' || n_nationkey || ']' AS w FROM {_FROM}""")
def json_value_and_query(spark, sf_dir):
    """JSON_VALUE and JSON_QUERY"""
    return rows(spark, sf_dir).select("n_nationkey", J.json_value("j", "$.name").alias("v"), J.json_value("j", "$.tags", "none").alias("d"), J.json_query("j", "$.tags").alias("q"), J.json_query("j", "$.id", True).alias("w"))


_SMALL = """'{"r":' || n_regionkey || ',"z":null}'"""


@plans.query("q_json_edits", f"""SELECT n_nationkey, '{{"r":9,"z":null}}' AS s, '{{"r":' || n_regionkey || ',"z":null,"n":[1]}}' AS i, '{{"r":' || n_regionkey || '}}' AS p, '{{"r":' || n_regionkey || '}}' AS d, '{{"r":null,"z":null}}' AS l, '{{"z":null}}' AS k, '{{\n    "r": ' || n_regionkey || ',\n    "z": null\n}}' AS y FROM {_FROM}""")
def json_edits(spark, sf_dir):
    """jsonb_set, jsonb_insert, jsonb_strip_nulls, #-, jsonb_set_lax and jsonb_pretty"""
    t = rows(spark, sf_dir).withColumn("o", F.expr(_SMALL))
    return t.select("n_nationkey", J.set_("o", ["r"], "9").alias("s"), J.insert("o", ["n"], "[1]").alias("i"), J.strip_nulls("o").alias("p"), J.delete_path("o", ["z"]).alias("d"), J.set_lax("o", ["r"], None).alias("l"), J.set_lax("o", ["r"], None, null_treatment="delete_key").alias("k"), J.pretty("o").alias("y"))


@plans.query("q_json_records", f"SELECT n_nationkey, n_nationkey AS id, n_name AS name, NULL::DOUBLE AS gone, n_nationkey AS pid, 'base' AS pmore FROM {_FROM}")
def json_records(spark, sf_dir):
    """json(b)_to_record and json(b)_populate_record"""
    base = F.struct(F.lit(None).cast("bigint").alias("id"), F.lit("base").alias("more"))
    t = rows(spark, sf_dir).select("n_nationkey", J.to_record("j", "id bigint, name string, gone double").alias("r"), J.populate_record(base, "j", "id bigint, more string").alias("p"))
    return t.select("n_nationkey", "r.id", "r.name", "r.gone", F.col("p.id").alias("pid"), F.col("p.more").alias("pmore"))


@plans.query("q_json_recordsets", """SELECT n_regionkey, n_nationkey AS id, n_name AS name, n_nationkey AS pid, 'x' AS pmore FROM nation""")
def json_recordsets(spark, sf_dir):
    """json(b)_to_recordset and json(b)_populate_recordset, of arrays made by json_agg"""
    t = Lake(spark, sf_dir).nation
    sets = t.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("a"))
    base = F.struct(F.lit(None).cast("bigint").alias("id"), F.lit("x").alias("more"))
    one = sets.select("n_regionkey", "a", J.to_recordset("a", "id bigint, name string").alias("r"))
    two = sets.select(F.col("n_regionkey").alias("g"), J.populate_recordset(base, "a", "id bigint, more string").alias("p"))
    both = one.join(two, (F.col("n_regionkey") == F.col("g")) & (F.col("r.id") == F.col("p.id")))
    return both.select("n_regionkey", "r.id", "r.name", F.col("p.id").alias("pid"), F.col("p.more").alias("pmore"))


@plans.query("q_json_constructors", f"""SELECT n_nationkey, '{{"k":"' || n_name || '","n":null}}' AS o, '{{"k":"' || n_name || '"}}' AS a, '{{"x":"1","y":"2"}}' AS f, '["' || n_nationkey || '","' || n_name || '"]' AS b, '{{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}}' AS r, '"' || n_name || '"' AS t, CAST(n_nationkey AS VARCHAR) AS c, j AS z, j AS p FROM {_FROM}""")
def json_constructors(spark, sf_dir):
    """json_object, json(b)_build_array, row_to_json, to_jsonb, json_scalar, json_serialize and json()"""
    return rows(spark, sf_dir).select(
        "n_nationkey", J.json_object(F.lit("k"), "n_name", F.lit("n"), F.lit(None)).alias("o"), J.json_object(F.lit("k"), "n_name", F.lit("n"), F.lit(None), absent_on_null=True).alias("a"), J.json_object(F.array(*map(F.lit, "x1y2"))).alias("f"),
        J.build_array("n_nationkey", "n_name").alias("b"), J.row_to_json("n_nationkey", "n_name").alias("r"), J.to_jsonb("n_name").alias("t"), J.scalar("n_nationkey").alias("c"), J.serialize("j").alias("z"), J.parse("j").alias("p"),
    )


@plans.query("q_json_object_agg", """SELECT n_regionkey, '{' || string_agg('"' || n_nationkey || '":"' || n_name || '"', ',' ORDER BY CAST(n_nationkey AS VARCHAR)) || '}' AS o FROM nation GROUP BY n_regionkey""")
def json_object_agg(spark, sf_dir):
    """json(b)_object_agg, in the order of keys"""
    return Lake(spark, sf_dir).nation.groupBy("n_regionkey").agg(J.object_agg("n_nationkey", "n_name").alias("o"))


@plans.query("q_is_json", f"SELECT n_nationkey, true AS v, true AS o, false AS a, n_nationkey % 2 = 0 AS s, n_nationkey % 3 > 0 AS x, false AS n FROM {_FROM}")
def is_json(spark, sf_dir):
    """IS JSON, VALUE, OBJECT, ARRAY and SCALAR"""
    mixed = F.when(F.col("n_nationkey") % 2 == 0, F.lit("12")).otherwise(F.lit("[12]"))
    broken = F.when(F.col("n_nationkey") % 3 == 0, F.lit("{oops")).otherwise(F.col("j"))
    return rows(spark, sf_dir).select("n_nationkey", J.is_json("j").alias("v"), J.is_json("j", "object").alias("o"), J.is_json("j", "array").alias("a"), J.is_json(mixed, "scalar").alias("s"), J.is_json(broken).alias("x"), J.is_json(F.lit("nope")).alias("n"))
