"""COPY, tables that are written and refreshed, foreign tables, sequences; XML documents; multiranges; small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import pg, pgxml, ranges
from quillon.operators import dml, srf
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans
from quillon.sources import copy, foreign_files, scratch

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles

_ODD = "c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN c_name || ',' || chr(9) || '\"x\"' ELSE c_name || '|' || chr(92) || 'N' END AS t"


def _odd(spark, sf_dir):
    """Names with delimiters, quotes, tabs and backslashes, and nulls."""
    t = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).when(F.col("c_custkey") % 4 == 1, F.concat("c_name", F.lit(',\t"x"'))).otherwise(F.concat("c_name", F.lit("|\\N")))
    return Lake(spark, sf_dir).customer.select("c_custkey", t.alias("t"))


@plans.query("q_copy_text", f"SELECT {_ODD} FROM customer")
def copy_text(spark, sf_dir):
    """COPY ... TO and FROM in text form with a delimiter that values hold"""
    path = scratch.new_path(spark)
    copy.copy_to(_odd(spark, sf_dir), path, "text", delimiter=",")
    return copy.copy_from(spark, path, "c_custkey bigint, t string", "text", delimiter=",")


@plans.query("q_copy_csv", f"SELECT {_ODD} FROM customer")
def copy_csv(spark, sf_dir):
    """CSV with a header, its own delimiter, null and quote, and values forced into quotes"""
    path = scratch.new_path(spark)
    copy.copy_to(_odd(spark, sf_dir), path, "csv", delimiter="|", null="nil", header=True, quote="'", force_quote=True)
    return copy.copy_from(spark, path, "c_custkey bigint, t string", "csv", delimiter="|", null="nil", header=True, quote="'")


@plans.query("q_copy_binary", "SELECT o_orderkey, o_totalprice FROM orders")
def copy_binary(spark, sf_dir):
    path = scratch.new_path(spark)
    copy.copy_to(Lake(spark, sf_dir).orders.select("o_orderkey", "o_totalprice"), path, "binary")
    return copy.copy_from(spark, path, "o_orderkey bigint, o_totalprice double", "binary")


@plans.query("q_copy_on_error", "SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0 AND c_custkey > 20")
def copy_on_error(spark, sf_dir):
    """ON_ERROR ignore leaves malformed rows out; WHERE chooses of the others"""
    path = scratch.new_path(spark)
    key = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    copy.copy_to(Lake(spark, sf_dir).customer.select(key.alias("k")), path, "text")
    return copy.copy_from(spark, path, "c_custkey bigint", "text", on_error="ignore", where=F.col("c_custkey") > 20)


@plans.query("q_create_table_as", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def create_table_as(spark, sf_dir):
    """SELECT INTO and CREATE TABLE AS; WITH NO DATA has the columns only"""
    some = Lake(spark, sf_dir).nation.filter("n_regionkey = 1").select("n_nationkey", "n_name")
    empty = copy.create_as(some, scratch.new_path(spark), with_data=False)
    return empty.unionByName(copy.create_as(some, scratch.new_path(spark)))


@plans.query("q_refresh", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def refresh(spark, sf_dir):
    """A materialized view of a part of the table, refreshed with the whole"""
    t, path = Lake(spark, sf_dir).nation, scratch.new_path(spark)
    copy.create_as(t.filter("n_nationkey < 3").groupBy("n_regionkey").agg(F.count("*").alias("n")), path)
    return copy.refresh(t.groupBy("n_regionkey").agg(F.count("*").alias("n")), path)


@plans.query("q_truncate", "SELECT count(*) AS before, 0::BIGINT AS after, 5 AS columns FROM region CROSS JOIN nation")
def truncate(spark, sf_dir):
    t = Lake(spark, sf_dir)
    both = t.region.crossJoin(F.broadcast(t.nation))  # five rows and 25
    empty = dml.truncate(both)
    return both.agg(F.count("*").alias("before")).crossJoin(empty.agg(F.count("*").alias("after"))).withColumn("columns", F.lit(len(empty.columns)))


@plans.query("q_foreign_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49")
def foreign_scan(spark, sf_dir):
    """Files under a server's options; the filter reaches them."""
    server = foreign_files.Server(spark, {"format": "parquet", "root": sf_dir})
    return server.table("lineitem.parquet").filter("l_quantity > 49").select("l_orderkey", "l_linenumber")


@plans.query("q_nextval", "SELECT c_custkey, 100 + 5 * (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) AS id FROM customer")
def nextval(spark, sf_dir):
    """nextval of a sequence that starts with 100 and goes up by 5"""
    t = Lake(spark, sf_dir).customer.select("c_custkey", (-F.col("c_acctbal")).alias("b"))
    return copy.nextval(t, "id", ["b", "c_custkey"], 100, 5).select("c_custkey", "id")


@plans.query("q_identity_fixup", "SELECT count(*) AS n, max(n_nationkey) + 1 AS low, count(*) AS different FROM nation")
def identity_fixup(spark, sf_dir):
    """Rows loaded with new identities after the largest that exists"""
    t = Lake(spark, sf_dir).nation
    made = copy.next_ids(t.drop("n_nationkey").withColumn("n_nationkey", F.lit(0)).coalesce(1), "n_nationkey", t)
    return made.agg(F.count("*").alias("n"), F.min("n_nationkey").cast("bigint").alias("low"), F.countDistinct("n_nationkey").alias("different"))


@plans.query("q_snapshot_staleness", "SELECT count(*) FILTER (WHERE n_nationkey > 20) AS added, count(*) FILTER (WHERE n_nationkey < 3) AS removed, true AS stale FROM nation")
def snapshot_staleness(spark, sf_dir):
    t = Lake(spark, sf_dir).nation
    snapshot = copy.folder_snapshot(t.filter("n_nationkey <= 20"), scratch.new_path(spark))
    return copy.stale(t.filter("n_nationkey >= 3"), snapshot)


@plans.query("q_package_check", "SELECT * FROM (VALUES ('b', 'changed'), ('c', 'missing'), ('d', 'extra')) t(path, state)")
def package_check(spark, sf_dir):
    """A package written, read back and held against its manifest"""
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, content string")
    manifest = copy.package_hashes(files.replace("2", "x")).filter("path <> 'd'").unionByName(spark.createDataFrame([("c", "0")], "path string, hash string"))
    return copy.verify_package(copy.create_as(files, scratch.new_path(spark)), copy.create_as(manifest, scratch.new_path(spark)))


@plans.query("q_srf_in_select", "SELECT n_nationkey, unnest(generate_series(1, n_regionkey)) AS k FROM nation")
def srf_in_select(spark, sf_dir):
    """generate_series in the SELECT list: a row for each value, none for an empty series"""
    return Lake(spark, sf_dir).nation.select("n_nationkey", F.explode(srf.series(F.lit(1), "n_regionkey")).alias("k"))


@plans.query("q_starts_operator", "SELECT p_partkey, starts_with(p_name, 'l') AS a, starts_with(p_name, substr(p_name, 1, 2)) AS b, true AS n, false AS d FROM part")
def starts_operator(spark, sf_dir):
    """^@, IS NORMALIZED of a composed and of a decomposed text"""
    return Lake(spark, sf_dir).part.select("p_partkey", pg.starts_with("p_name", "l").alias("a"), pg.starts_with("p_name", F.substring("p_name", 1, 2)).alias("b"), pg.is_normalized(F.concat("p_name", F.lit("é")), "NFC").alias("n"), pg.is_normalized(F.concat("p_name", F.lit("é")), "NFC").alias("d"))


_X = "'<n xmlns:q=\"urn:q\" key=\"' || n_nationkey || '\"><name>' || n_name || '</name></n>'"


@plans.query("q_xml_functions", f"SELECT n_nationkey, '<!--' || n_name || '-->' AS c, '<?go ' || n_name || '?>' AS i, '<a>' || n_nationkey || '</a><b>x</b>' AS k, '<?xml version=\"1.0\" standalone=\"yes\"?><a/>' AS r, 'a &lt; b &amp; ' || n_name AS t, [n_name] AS p, {_X} AS s, octet_length(encode({_X})) AS z, true AS d, false AS f FROM nation")
def xml_functions(spark, sf_dir):
    """xmlcomment, xmlpi, xmlconcat, xmlroot, xmltext, xpath, xmlparse, xmlserialize, xmlnamespaces, IS DOCUMENT"""
    x = pgxml.element("n", pgxml.namespaces({"q": "urn:q"}) | {"key": "n_nationkey"}, pgxml.forest(name="n_name"))
    two = pgxml.concat(pgxml.forest(a="n_nationkey"), F.lit("<b>x</b>"))
    t = Lake(spark, sf_dir).nation.select("*", x.alias("x"))
    return t.select(
        "n_nationkey", pgxml.comment("n_name").alias("c"), pgxml.instruction("go", "n_name").alias("i"), two.alias("k"), pgxml.root(F.lit("<a/>"), standalone="yes").alias("r"), pgxml.text(F.concat(F.lit("a < b & "), "n_name")).alias("t"),
        pgxml.xpath("x", "/n/name/text()").alias("p"), pgxml.serialize(pgxml.parse("x")).alias("s"), F.octet_length(pgxml.serialize("x", "binary")).cast("bigint").alias("z"), pgxml.is_document("x").alias("d"), pgxml.is_document(two).alias("f"),
    )


_ROW = "'<row><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || r_name || '</r_name></row>'"
_XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


@plans.query("q_table_to_xml", f"SELECT '<region {_XSI}>' || string_agg({_ROW}, '' ORDER BY r_regionkey) || '</region>' AS xml FROM region")
def table_to_xml(spark, sf_dir):
    """table_to_xml, and query_to_xml of the same query"""
    return pgxml.table_to_xml(Lake(spark, sf_dir).region.select("r_regionkey", "r_name"), "region", "r_regionkey")


_XSD = '<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema"><xsd:complexType name="RowType.region"><xsd:sequence><xsd:element name="r_regionkey" type="xsd:long" minOccurs="0"></xsd:element><xsd:element name="r_name" type="xsd:string" minOccurs="0"></xsd:element></xsd:sequence></xsd:complexType>'
_TABLE = '<xsd:complexType name="TableType.region"><xsd:sequence><xsd:element name="row" type="RowType.region" minOccurs="0" maxOccurs="unbounded"/></xsd:sequence></xsd:complexType><xsd:element name="region" type="TableType.region"/></xsd:schema>'


@plans.query("q_table_to_xmlschema", f"SELECT '{_XSD}{_TABLE}' AS xml")
def table_to_xmlschema(spark, sf_dir):
    t = Lake(spark, sf_dir).region.select(F.col("r_regionkey").cast("bigint"), "r_name")
    return spark.createDataFrame([(pgxml.table_to_xmlschema(t, "region"),)], "xml string")


@plans.query("q_table_to_xml_and_xmlschema", f"SELECT '<region {_XSI}>' || '{_XSD}{_TABLE}' || string_agg({_ROW}, '' ORDER BY r_regionkey) || '</region>' AS xml FROM region")
def table_to_xml_and_xmlschema(spark, sf_dir):
    t = Lake(spark, sf_dir).region.select(F.col("r_regionkey").cast("bigint"), "r_name")
    return pgxml.table_to_xml_and_xmlschema(t, "region", "r_regionkey")


@plans.query("q_schema_to_xml", f"SELECT '<main {_XSI}><aregion>' || (SELECT string_agg({_ROW}, '' ORDER BY r_regionkey) FROM region) || '</aregion><bnation>' || (SELECT string_agg('<row><n_nationkey>' || n_nationkey || '</n_nationkey></row>', '' ORDER BY n_nationkey) FROM nation) || '</bnation></main>' AS xml")
def schema_to_xml(spark, sf_dir):
    t = Lake(spark, sf_dir)
    return pgxml.schema_to_xml({"aregion": (t.region.select("r_regionkey", "r_name"), "r_regionkey"), "bnation": (t.nation.select("n_nationkey"), "n_nationkey")}, "main")


@plans.query("q_schema_to_xmlschema", f"SELECT '{_XSD}' || '<xsd:complexType name=\"SchemaType.main\"><xsd:all><xsd:element name=\"region\" type=\"RowType.region\"/></xsd:all></xsd:complexType><xsd:element name=\"main\" type=\"SchemaType.main\"/></xsd:schema>' AS xml")
def schema_to_xmlschema(spark, sf_dir):
    t = Lake(spark, sf_dir).region.select(F.col("r_regionkey").cast("bigint"), "r_name")
    return spark.createDataFrame([(pgxml.schema_to_xmlschema({"region": t}, "main"),)], "xml string")


@plans.query("q_multiranges", "SELECT p_partkey, [p_size, CASE WHEN p_size < 20 THEN 40 ELSE p_size + 30 END] AS lows, [p_size + 10, CASE WHEN p_size < 20 THEN 45 ELSE p_size + 35 END] AS highs FROM part")
def multiranges(spark, sf_dir):
    """int4multirange, int8multirange and their kin: merged, sorted, without empty ranges"""
    x = F.col("p_size").cast("int")
    far = F.when(x < 20, F.lit(40)).otherwise(x + 30)
    parts = F.array(ranges.make(far, far + 5), ranges.make(x, x + 4), ranges.make(x + 4, x + 10), ranges.make(x, x))
    rows = Lake(spark, sf_dir).part.select("p_partkey", ranges.multirange(parts).alias("m"))
    return rows.select("p_partkey", F.transform("m", lambda r: r["lower"]).alias("lows"), F.transform("m", lambda r: r["upper"]).alias("highs"))


@plans.query("q_typed_multiranges", "SELECT o_orderkey, 1 AS nums, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderdate AS DATE) + 9 AS d1, o_orderdate AS t0, o_orderdate + INTERVAL 2 HOUR AS t1 FROM orders")
def typed_multiranges(spark, sf_dir):
    """nummultirange, datemultirange and tsmultirange of touching ranges"""
    d, ts, n = F.to_date("o_orderdate"), F.col("o_orderdate"), F.col("o_totalprice")
    later = lambda c, hours: c + F.expr(f"interval {hours} hours")
    rows = Lake(spark, sf_dir).orders.select(
        "o_orderkey", ranges.multirange(F.array(ranges.make(n, n + 1.0), ranges.make(n + 1.0, n + 2.0))).alias("n"),
        ranges.multirange(F.array(ranges.make(F.date_add(d, 4), F.date_add(d, 9)), ranges.make(d, F.date_add(d, 5)))).alias("d"), ranges.multirange(F.array(ranges.make(ts, later(ts, 1)), ranges.make(later(ts, 1), later(ts, 2)))).alias("t"),
    )
    ntz = lambda c: c.cast("timestamp_ntz")
    return rows.select("o_orderkey", F.size("n").alias("nums"), F.col("d")[0]["lower"].alias("d0"), F.col("d")[0]["upper"].alias("d1"), ntz(F.col("t")[0]["lower"]).alias("t0"), ntz(F.col("t")[0]["upper"]).alias("t1"))


@plans.query("q_range_bounds", "SELECT p_partkey, p_size % 2 = 0 AS empty, p_size % 2 <> 0 AS low_in, false AS up_in, p_size % 3 = 0 AS low_inf, false AS up_inf FROM part")
def range_bounds(spark, sf_dir):
    """isempty, lower_inc, upper_inc, lower_inf, upper_inf"""
    x = F.col("p_size")
    a, b = ranges.make(x, x + x % 2), ranges.make(F.when(x % 3 != 0, x), x + 1)
    return Lake(spark, sf_dir).part.select("p_partkey", ranges.isempty(a).alias("empty"), ranges.lower_inc(a).alias("low_in"), ranges.upper_inc(b).alias("up_in"), ranges.lower_inf(b).alias("low_inf"), ranges.upper_inf(b).alias("up_inf"))
