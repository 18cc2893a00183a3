"""Scalar functions and operators whose meaning differs from Spark's own, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import pg, pgjson, pgxml, ranges
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles


@plans.query("q_integer_arithmetic", "SELECT p_partkey, (p_partkey - 50) // 7 + CASE WHEN (p_partkey - 50) < 0 AND (p_partkey - 50) % 7 <> 0 AND (p_partkey - 50) // 7 * 7 <> (p_partkey - 50) AND (p_partkey - 50) // 7 < (p_partkey - 50) / 7 THEN 1 ELSE 0 END AS q, (p_partkey - 50) % 7 AS r, CAST(gcd(p_partkey, 36) AS BIGINT) AS g, CAST(lcm(p_partkey, 12) AS BIGINT) AS l FROM part")
def integer_arithmetic(spark, sf_dir):
    x = F.col("p_partkey") - 50
    return Lake(spark, sf_dir).part.select("p_partkey", pg.int_div(x, F.lit(7)).alias("q"), (x % 7).alias("r"), pg.gcd("p_partkey", F.lit(36)).alias("g"), pg.lcm("p_partkey", F.lit(12)).alias("l"))


@plans.query("q_rounding", "SELECT p_partkey, round_even((p_partkey - 40) / 2.0::DOUBLE, 0) + 0.0 AS even, trunc((p_partkey - 40) / 8.0::DOUBLE) + 0.0 AS cut, ceil(p_retailprice / 7) AS up, floor(p_retailprice / 7) AS down, sign(p_partkey - 40)::DOUBLE AS s FROM part")
def rounding(spark, sf_dir):
    x = F.col("p_partkey") - 40
    t = Lake(spark, sf_dir).part
    return t.select("p_partkey", (pg.pg_round(x / 2) + 0.0).alias("even"), pg.trunc(x / 8).alias("cut"), F.ceil(F.col("p_retailprice") / 7).cast("double").alias("up"), F.floor(F.col("p_retailprice") / 7).cast("double").alias("down"), F.sign(x).alias("s"))


@plans.query("q_powers_and_roots", "SELECT p_partkey, round(pow(p_size, 3), 6) AS cube, round(sqrt(p_size), 9) AS root, round(cbrt(p_size), 9) AS cube_root, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS l10, round(log(2, p_size), 9) AS l2, round(exp(p_size / 10.0::DOUBLE), 6) AS e FROM part")
def powers_and_roots(spark, sf_dir):
    r = lambda c, n=9: F.round(c, n)
    return Lake(spark, sf_dir).part.select("p_partkey", r(F.pow("p_size", F.lit(3)), 6).alias("cube"), r(pg.pg_sqrt("p_size")).alias("root"), r(F.cbrt("p_size")).alias("cube_root"), r(F.ln("p_size")).alias("l"), r(pg.log("p_size")).alias("l10"), r(pg.log("p_size", F.lit(2))).alias("l2"), r(F.exp(F.col("p_size") / 10), 6).alias("e"))


@plans.query("q_trigonometry", "SELECT p_partkey, round(sin(radians(p_size)), 9) AS s, round(cos(radians(p_size)), 9) AS c, round(tan(radians(p_size)), 9) AS t, round(degrees(asin(p_size / 60.0)), 9) AS a, round(degrees(atan2(p_size, 3)), 9) AS a2, round(sinh(p_size / 20.0::DOUBLE), 9) AS h FROM part")
def trigonometry(spark, sf_dir):
    r = lambda c: F.round(c, 9)
    return Lake(spark, sf_dir).part.select("p_partkey", r(pg.sind("p_size")).alias("s"), r(pg.cosd("p_size")).alias("c"), r(pg.tand("p_size")).alias("t"), r(pg.asind(F.col("p_size") / 60.0)).alias("a"), r(pg.atan2d("p_size", F.lit(3))).alias("a2"), r(F.sinh(F.col("p_size") / 20.0)).alias("h"))


@plans.query("q_special_functions", "SELECT p_partkey, round(gamma(p_size / 7.0::DOUBLE), 6) AS g, round(lgamma(p_size / 7.0::DOUBLE), 9) AS lg FROM part")
def special_functions(spark, sf_dir):
    x = F.col("p_size") / 7
    return Lake(spark, sf_dir).part.select("p_partkey", F.round(pg.gamma(x), 6).alias("g"), F.round(pg.lgamma(x), 9).alias("lg"))


plans.sql("q_bits", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 12 AS o, p_partkey ^ 12 AS x, ~p_partkey AS n, shiftleft(p_partkey, 2) AS l, shiftright(p_partkey, 1) AS r, CAST(bit_count(p_partkey) AS INT) AS c FROM {part}", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 12 AS o, xor(p_partkey, 12) AS x, ~p_partkey AS n, p_partkey << 2 AS l, p_partkey >> 1 AS r, CAST(bit_count(p_partkey) AS INTEGER) AS c FROM part")
plans.sql("q_width_bucket", "SELECT o_orderkey, CAST(width_bucket(o_totalprice, 0.0D, 500000.0D, 10) AS BIGINT) AS b FROM {orders}", "SELECT o_orderkey, CAST(floor(o_totalprice / 50000) + 1 AS BIGINT) AS b FROM orders")


@plans.query("q_text_functions", "SELECT c_custkey, upper(c_name) AS u, left(c_name, -2) AS l, right(c_name, 3) AS r, lpad(c_mktsegment, 12, '*') AS p, reverse(c_name) AS v, replace(c_name, '#', '-') AS q, split_part(c_name, '#', 2) AS s, translate(c_mktsegment, 'AEI', 'aei') AS t, CAST(instr(c_name, '#') AS INTEGER) AS i, md5(c_name) AS m, repeat('x', 3) AS x FROM customer")
def text_functions(spark, sf_dir):
    return Lake(spark, sf_dir).customer.select(
        "c_custkey", F.upper("c_name").alias("u"), pg.left("c_name", -2).alias("l"), pg.right("c_name", 3).alias("r"), F.lpad("c_mktsegment", 12, "*").alias("p"), F.reverse("c_name").alias("v"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("q"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("s"), F.translate("c_mktsegment", "AEI", "aei").alias("t"),
        F.instr("c_name", "#").alias("i"), F.md5("c_name").alias("m"), F.repeat(F.lit("x"), 3).alias("x"),
    )


@plans.query("q_null_skipping_concat", "SELECT doc_id, concat(lang, '/', source) AS a, concat_ws('-', lang, source) AS b, CASE WHEN lang IS NULL THEN 'NULL' ELSE '''' || replace(lang, '''', '''''') || '''' END AS c FROM documents")
def null_skipping_concat(spark, sf_dir):
    return Lake(spark, sf_dir).documents.select("doc_id", pg.concat("lang", F.lit("/"), "source").alias("a"), F.concat_ws("-", "lang", "source").alias("b"), pg.quote_nullable("lang").alias("c"))


@plans.query("q_substr_before_start", "SELECT c_custkey, substring(c_name, 1, 1) AS a, substring(c_name, 3) AS b, substring(c_name, 1, 4) AS c FROM customer")
def substr_before_start(spark, sf_dir):
    return Lake(spark, sf_dir).customer.select("c_custkey", pg.substr("c_name", 0, 2).alias("a"), pg.substr("c_name", 3).alias("b"), pg.substr("c_name", -2, 7).alias("c"))


@plans.query("q_hex_and_codes", "SELECT p_partkey, lower(to_hex(p_partkey)) AS h, chr(CAST(960 + p_size AS INTEGER)) AS c, unicode(p_name) AS a, sha256(p_name) AS s, base64(encode(p_brand)) AS b FROM part")
def hex_and_codes(spark, sf_dir):
    return Lake(spark, sf_dir).part.select("p_partkey", pg.to_hex("p_partkey").alias("h"), pg.chr_(F.col("p_size") + 960).alias("c"), F.ascii("p_name").alias("a"), F.sha2("p_name", 256).alias("s"), pg.encode("p_brand", "base64").alias("b"))


@plans.query("q_format", "SELECT n_nationkey, 'key ' || n_nationkey || ' is ''' || n_name || ''' 100%' AS t FROM nation")
def format_(spark, sf_dir):
    return Lake(spark, sf_dir).nation.select("n_nationkey", pg.format_("key %s is %2$L 100%%", "n_nationkey", "n_name").alias("t"))


@plans.query("q_regexps", r"SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS f, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS g, regexp_replace(p_brand, '(\w+)#(\d)', '\2-\1') AS b, CAST(len(regexp_extract_all(p_type, '[A-Z]+')) AS INTEGER) AS n, regexp_extract(p_brand, '(\d)(\d)', 2) AS e, array_to_string(regexp_split_to_array(p_type, '\s+'), '|') AS s FROM part")
def regexps(spark, sf_dir):
    return Lake(spark, sf_dir).part.select(
        "p_partkey", pg.regexp_replace("p_type", "[AEIOU]", "_").alias("f"), pg.regexp_replace("p_type", "[AEIOU]", "_", "g").alias("g"), pg.regexp_replace("p_brand", r"(\w+)#(\d)", r"\2-\1").alias("b"),
        F.regexp_count("p_type", F.lit("[A-Z]+")).alias("n"), F.coalesce(pg.regexp_match("p_brand", r"(\d)(\d)")[1], F.lit("")).alias("e"), F.array_join(pg.regexp_split("p_type", r"\s+"), "|").alias("s"),
    )


@plans.query("q_date_parts", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q, CAST(dayofweek(o_orderdate) AS BIGINT) AS w, CAST(isodow(o_orderdate) AS BIGINT) AS i, CAST(extract(doy FROM o_orderdate) AS BIGINT) AS d, CAST(extract(week FROM o_orderdate) AS BIGINT) AS k, CAST(extract(decade FROM o_orderdate) AS BIGINT) AS e, CAST(extract(century FROM o_orderdate) AS BIGINT) AS c, epoch(o_orderdate) AS p FROM orders")
def date_parts(spark, sf_dir):
    part = lambda f: pg.extract(f, "o_orderdate").cast("bigint")
    return Lake(spark, sf_dir).orders.select("o_orderkey", *(part(f).alias(a) for f, a in (("year", "y"), ("quarter", "q"), ("dow", "w"), ("isodow", "i"), ("doy", "d"), ("week", "k"), ("decade", "e"), ("century", "c"))), pg.extract("epoch", "o_orderdate").cast("double").alias("p"))


@plans.query("q_date_trunc", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w, CAST(date_trunc('decade', o_orderdate) AS TIMESTAMP) AS d, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS n, o_orderdate + INTERVAL 1 MONTH AS later FROM orders")
def date_trunc(spark, sf_dir):
    ts = lambda c: c.cast("timestamp_ntz")
    return Lake(spark, sf_dir).orders.select("o_orderkey", ts(pg.date_trunc("month", "o_orderdate")).alias("m"), ts(pg.date_trunc("week", "o_orderdate")).alias("w"), ts(pg.date_trunc("decade", "o_orderdate")).alias("d"), pg.date_minus("o_orderdate", F.lit("1992-01-01").cast("date")).alias("n"), (F.col("o_orderdate") + F.expr("interval 1 month")).alias("later"))


@plans.query("q_to_char", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS a, strftime(o_orderdate, '%d %b %y') AS b FROM orders")
def to_char(spark, sf_dir):
    return Lake(spark, sf_dir).orders.select("o_orderkey", pg.to_char("o_orderdate", "YYYY-MM-DD HH24:MI").alias("a"), pg.to_char("o_orderdate", "DD Mon YY").alias("b"))


_WORDS = "string_split(p_name, ' ')"


@plans.query("q_array_functions", f"SELECT p_partkey, CAST(len({_WORDS}) AS INTEGER) AS n, {_WORDS}[1] AS a, {_WORDS}[99] AS z, array_to_string({_WORDS}[2:3], '+') AS s, array_to_string(list_append({_WORDS}, 'end'), ' ') AS e, CAST(list_position({_WORDS}, {_WORDS}[2]) AS BIGINT) AS p, '[1:' || len({_WORDS}) || ']' AS d, list_has_all({_WORDS}, [{_WORDS}[1]]) AS h, list_has_any({_WORDS}, ['lemon', 'navy']) AS o FROM part")
def array_functions(spark, sf_dir):
    words = F.split("p_name", " ")
    return Lake(spark, sf_dir).part.select(
        "p_partkey", pg.array_length(words).alias("n"), pg.array_at(words, 1).alias("a"), pg.array_at(words, 99).alias("z"), pg.array_to_string(pg.array_slice(words, 2, 3), "+").alias("s"),
        F.array_join(F.array_append(words, "end"), " ").alias("e"), F.array_position(words, pg.array_at(words, 2)).alias("p"), pg.array_dims(words).alias("d"),
        pg.array_contains_all(words, F.array(pg.array_at(words, 1))).alias("h"), F.arrays_overlap(words, F.array(F.lit("lemon"), F.lit("navy"))).alias("o"),
    )


@plans.query("q_json_navigation", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS m, json_exists(props, '$.k') AS h, 'object' AS t FROM events WHERE props IS NOT NULL")
def json_navigation(spark, sf_dir):
    return Lake(spark, sf_dir).events.filter("props is not null").select("event_id", pgjson.get_text("props", "k").alias("k"), pgjson.get_text("props", "missing").alias("m"), pgjson.has_key("props", "k").alias("h"), pgjson.typeof("props").alias("t"))


@plans.query("q_json_construction", """SELECT n_regionkey, '{"name":"' || r_name || '","key":' || n_regionkey || '}' AS o, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']' AS a FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey, r_name""")
def json_construction(spark, sf_dir):
    t = Lake(spark, sf_dir)
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_regionkey", "r_name").agg(pgjson.agg("n_name").alias("a")).select("n_regionkey", pgjson.build_object(name="r_name", key="n_regionkey").alias("o"), "a")


@plans.query("q_json_changes", """SELECT event_id, '{"k":' || json_extract(props, '$.k') || ',"new":[1]}' AS s, '{}' AS d, contains(props, '"k"') AS c FROM events WHERE props IS NOT NULL""")
def json_changes(spark, sf_dir):
    rows = Lake(spark, sf_dir).events.filter("props is not null")
    made = pgjson.together("props", s=pgjson.setting(["new"], "[1]"), d=pgjson.deleting(["k"]), c=pgjson.existing("$.k"))
    return rows.select("event_id", made.alias("made")).select("event_id", "made.*")


@plans.query("q_range_operators", "SELECT p_partkey, (p_size <= 20 AND 20 < p_size + 10) AS has, (p_size < 25 AND 15 < p_size + 10) AS overlaps, p_size + 10 <= 15 AS before, (p_size + 10 = 15 OR p_size = 25) AS touches, CASE WHEN p_size < 25 AND 15 < p_size + 10 THEN '[' || greatest(p_size, 15) || ',' || least(p_size + 10, 25) || ')' ELSE 'empty' END AS common, '[' || least(p_size, 15) || ',' || greatest(p_size + 10, 25) || ')' AS both FROM part")
def range_operators(spark, sf_dir):
    rows = Lake(spark, sf_dir).part.select("p_partkey", ranges.make("p_size", F.col("p_size") + 10).alias("a"), ranges.make(F.lit(15), F.lit(25)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("p_partkey", ranges.contains_value(a, F.lit(20)).alias("has"), ranges.overlaps(a, b).alias("overlaps"), ranges.left_of(a, b).alias("before"), ranges.adjacent(a, b).alias("touches"), ranges.text(ranges.intersection(a, b)).alias("common"), ranges.text(ranges.merge(a, b)).alias("both"))


@plans.query("q_xml_construction", "SELECT n_nationkey, '<nation key=\"' || n_nationkey || '\"><name>' || n_name || '</name></nation>' AS x, true AS e, true AS w FROM nation")
def xml_construction(spark, sf_dir):
    x = pgxml.element("nation", {"key": "n_nationkey"}, pgxml.forest(name="n_name"))
    return Lake(spark, sf_dir).nation.select("n_nationkey", x.alias("x")).select("n_nationkey", "x", pgxml.exists("x", "/nation/name").alias("e"), pgxml.well_formed("x").alias("w"))
