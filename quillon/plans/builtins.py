"""Numbers, text, times, arrays and aggregates of the function inventory that no other module registers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillon.functions import pg
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles


def r(c, n: int = 9):
    return F.round(c, n)


@plans.query("q_inverse_trigonometry", "SELECT p_partkey, round(acos(p_size / 60.0), 9) AS a, round(atan(p_size), 9) AS t, round(cot(p_size), 6) AS c, round(degrees(acos(p_size / 60.0)), 9) AS ad, round(degrees(atan(p_size)), 9) AS td, round(1 / tan(radians(p_size + 1)), 9) AS cd FROM part")
def inverse_trigonometry(spark, sf_dir):
    x = F.col("p_size")
    return Lake(spark, sf_dir).part.select("p_partkey", r(pg.acos(x / 60.0)).alias("a"), r(F.atan(x)).alias("t"), r(F.cot(x), 6).alias("c"), r(pg.acosd(x / 60.0)).alias("ad"), r(pg.atand(x)).alias("td"), r(pg.cotd(x + 1)).alias("cd"))


@plans.query("q_hyperbolic", "SELECT p_partkey, round(acosh(p_size), 9) AS ac, round(asinh(p_size), 9) AS ash, round(atanh(p_size / 60.0::DOUBLE), 9) AS ath, round(cosh(p_size / 20.0::DOUBLE), 9) AS ch, round(tanh(p_size / 20.0::DOUBLE), 9) AS th FROM part")
def hyperbolic(spark, sf_dir):
    x = F.col("p_size")
    return Lake(spark, sf_dir).part.select("p_partkey", r(pg.acosh(x)).alias("ac"), r(F.asinh(x)).alias("ash"), r(pg.atanh(x / 60.0)).alias("ath"), r(F.cosh(x / 20.0)).alias("ch"), r(F.tanh(x / 20.0)).alias("th"))


@plans.query("q_number_basics", "SELECT p_partkey, abs(p_partkey - 50) AS a, CAST(ceiling(p_retailprice / 3) AS BIGINT) AS c, mod(p_partkey - 50, 7) AS m, round(power(p_size, 1.5), 6) AS w, round(pi() * p_size, 9) AS p, CAST(trunc((p_partkey - 50) / 7) AS BIGINT) AS d, CAST(factorial(CAST(p_size % 20 AS INTEGER)) AS DOUBLE) AS f, CAST(replace(printf('%,d', p_partkey * 1000), ',', '') AS BIGINT) AS n FROM part")
def number_basics(spark, sf_dir):
    k = F.col("p_partkey") - 50
    return Lake(spark, sf_dir).part.select(
        "p_partkey", F.abs(k).alias("a"), F.ceiling(F.col("p_retailprice") / 3).cast("bigint").alias("c"), F.call_function("mod", k, F.lit(7)).cast("bigint").alias("m"),
        r(pg.power("p_size", F.lit(1.5)), 6).alias("w"), r(F.pi() * F.col("p_size")).alias("p"), pg.int_div(k, F.lit(7)).alias("d"),
        pg.factorial(F.col("p_size") % 20).cast("double").alias("f"), pg.to_number(F.format_number(F.col("p_partkey") * 1000, 0), "999,999,999").cast("bigint").alias("n"),
    )


@plans.query("q_scales", "SELECT o_orderkey, CAST(len(split_part(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '.', 2)) AS INTEGER) AS s, CAST(len(rtrim(split_part(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '.', 2), '0')) AS INTEGER) AS m, rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '0'), '.') AS t FROM orders")
def scales(spark, sf_dir):
    x = F.col("o_totalprice").cast("decimal(18,4)")
    return Lake(spark, sf_dir).orders.select("o_orderkey", pg.scale(x).alias("s"), pg.min_scale(x).alias("m"), pg.trim_scale(x).alias("t"))


_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: pow(-1, n) * pow(p_size / 20.0::DOUBLE, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"


@plans.query("q_error_functions", f"SELECT p_partkey, round({_ERF}, 9) AS e, round(1 - {_ERF}, 9) AS c FROM part")
def error_functions(spark, sf_dir):
    x = F.col("p_size") / 20
    return Lake(spark, sf_dir).part.select("p_partkey", r(pg.erf(x)).alias("e"), r(pg.erfc(x)).alias("c"))


@plans.query("q_random", "SELECT count(*) AS n, true AS in_range, true AS around, true AS bounded, true AS repeats FROM lineitem")
def random_(spark, sf_dir):
    """What draws must hold: range, mean, bounds, and the same numbers after the same seed."""
    seed = pg.setseed(0.25)
    rows = Lake(spark, sf_dir).lineitem.select(pg.random().alias("u"), pg.random_normal(5.0, 2.0, 3).alias("g"), pg.random_between(3, 9, 4).alias("i"), pg.random(seed).alias("a"), pg.random(pg.setseed(0.25)).alias("b"))
    return rows.agg(F.count("*").alias("n"), F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_range"), (F.abs(F.avg("g") - 5) < 0.5).alias("around"), F.bool_and(F.col("i").between(3, 9)).alias("bounded"), F.bool_and(F.col("a") == F.col("b")).alias("repeats"))


@plans.query("q_lengths", "SELECT doc_id, CAST(bit_length(coalesce(text, '')) AS BIGINT) AS b, CAST(length(coalesce(text, '')) AS BIGINT) AS l, CAST(length(coalesce(text, '')) AS BIGINT) AS c, CAST(length(coalesce(text, '')) AS BIGINT) AS ch, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS o FROM documents")
def lengths(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return Lake(spark, sf_dir).documents.select("doc_id", F.bit_length(t).cast("bigint").alias("b"), F.length(t).cast("bigint").alias("l"), F.char_length(t).cast("bigint").alias("c"), F.character_length(t).cast("bigint").alias("ch"), F.octet_length(t).cast("bigint").alias("o"))


@plans.query("q_trimming", "SELECT c_custkey, trim('  ' || c_name || ' ') AS t, trim(c_name, 'Cr0') AS b, ltrim(c_name, 'Cust') AS l, rtrim(c_name, '0123456789') AS r, rpad(c_mktsegment, 12, '.-') AS p, CAST(strpos(c_name, '#') AS INTEGER) AS s, CAST(strpos(c_name, 'mer') AS INTEGER) AS q, starts_with(c_name, 'Cust') AS w, starts_with(c_mktsegment, 'B') AS h FROM customer")
def trimming(spark, sf_dir):
    return Lake(spark, sf_dir).customer.select(
        "c_custkey", F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("t"), pg.btrim("c_name", "Cr0").alias("b"), pg.ltrim("c_name", "Cust").alias("l"), pg.rtrim("c_name", "0123456789").alias("r"),
        F.rpad("c_mktsegment", 12, ".-").alias("p"), pg.strpos("c_name", "#").alias("s"), pg.position("mer", "c_name").alias("q"), pg.starts_with("c_name", "Cust").alias("w"), F.startswith("c_mktsegment", F.lit("B")).alias("h"),
    )


@plans.query("q_text_rewriting", "SELECT c_custkey, 'XY' || substr(c_name, 3) AS o, substr(c_name, 1, 4) || '-' || substr(c_name, 10) AS v, 'Customer#' || substr(c_name, 10) AS i, lower(c_mktsegment) || 'ss' AS f, 'Creme ' || c_mktsegment AS a, c_name || 'é' AS u, true AS n, list_transform(['shop', 'Big Table'], lambda x: x) AS d FROM customer")
def text_rewriting(spark, sf_dir):
    name = F.col("c_name")
    return Lake(spark, sf_dir).customer.select(
        "c_custkey", pg.overlay(name, "XY", 1).alias("o"), pg.overlay(name, "-", 5, 5).alias("v"), pg.initcap(name).alias("i"), pg.casefold(F.concat("c_mktsegment", F.lit("ß"))).alias("f"),
        pg.to_ascii(F.concat(F.lit("Crème "), "c_mktsegment")).alias("a"), pg.normalize(F.concat(name, F.lit("é"))).alias("u"), pg.is_normalized(F.concat(name, F.lit("é"))).alias("n"), pg.parse_ident(F.lit('Shop."Big Table"')).alias("d"),
    )


_SHA = {n: hashlib.new(f"sha{n}", b"BUILDING").hexdigest() for n in (224, 384, 512)}


@plans.query("q_encodings", "SELECT c_custkey, c_name AS back, c_mktsegment AS d, octet_length(encode(c_name)) + 2 AS n, CAST(octet_length(encode(c_name)) + 1 AS BIGINT) AS m, c_name || 'é' AS u, 'UTF8' AS e, true AS v, true AS g, true AS s FROM customer")
def encodings(spark, sf_dir):
    accented = F.concat("c_name", F.lit("é"))
    known = F.array(*(F.unhex(F.lit(x)) for x in _SHA.values()))
    return Lake(spark, sf_dir).customer.select(
        "c_custkey", pg.convert_from(pg.convert_to("c_name", "UTF8"), "UTF8").alias("back"), F.decode(pg.decode(pg.encode("c_mktsegment", "hex"), "hex"), "UTF-8").alias("d"),
        F.octet_length(pg.convert_to(accented, "UTF8")).cast("bigint").alias("n"), F.octet_length(pg.convert(pg.convert_to(accented, "UTF8"), "UTF8", "LATIN1")).cast("bigint").alias("m"),
        pg.unistr(F.concat("c_name", F.lit("\\00e9"))).alias("u"), pg.client_encoding().alias("e"), pg.version().rlike(r"^Spark \d+\.").alias("v"), pg.gen_random_uuid().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("g"),
        (F.array(*(pg.sha(F.lit("BUILDING"), n) for n in _SHA)) == known).alias("s"),
    )


@plans.query("q_quoting", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE '\"' || n_name || '\"' END AS i, '''' || n_name || '''''s''' AS l FROM nation WHERE n_name NOT LIKE '% %'")
def quoting(spark, sf_dir):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    return Lake(spark, sf_dir).nation.filter("n_name not like '% %'").select("n_nationkey", pg.quote_ident(name).alias("i"), pg.quote_literal(F.concat("n_name", F.lit("'s"))).alias("l"))


@plans.query("q_string_to_table", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n FROM part")
def string_to_table(spark, sf_dir):
    return Lake(spark, sf_dir).part.select("p_partkey", pg.string_to_table("p_name", " ").alias("w"), F.size(pg.string_to_array("p_name", " ")).alias("n"))


@plans.query("q_regexp_places", "SELECT p_partkey, regexp_matches(p_name, 'lemon|navy') AS k, CAST(strpos(p_name, ' ') AS INTEGER) AS i, CAST(len(string_split(p_name, ' ')[1]) + len(string_split(p_name, ' ')[2]) + 2 AS INTEGER) AS j, string_split(p_name, ' ')[2] AS s, CAST(strpos(substr(p_name, 3), ' ') + 2 AS INTEGER) AS f, CAST(0 AS INTEGER) AS z, regexp_matches(p_name, '(?i)NAVY') AS c FROM part")
def regexp_places(spark, sf_dir):
    return Lake(spark, sf_dir).part.select(
        "p_partkey", pg.regexp_like("p_name", "lemon|navy").alias("k"), pg.regexp_instr("p_name", r"\s").alias("i"), pg.regexp_instr("p_name", "[a-z]+", 1, 2, True).alias("j"), pg.regexp_substr("p_name", "[a-z]+", 1, 2).alias("s"),
        pg.regexp_instr("p_name", r"\s", 3).alias("f"), pg.regexp_instr("p_name", "[0-9]").alias("z"), pg.regexp_like("p_name", "NAVY", "i").alias("c"),
    )


@plans.query("q_collate", "SELECT n_nationkey, n_name = upper(n_name) AS same, lower(n_name) = lower('fRANCE') AS folded, n_name < 'a' AS bytes FROM nation")
def collate(spark, sf_dir):
    return Lake(spark, sf_dir).nation.select("n_nationkey", (pg.collate("n_name", "C") == F.upper("n_name")).alias("same"), (pg.collate("n_name", "UNICODE_CI") == F.lit("fRANCE")).alias("folded"), (pg.collate("n_name", "POSIX") < F.lit("a")).alias("bytes"))


@plans.query("q_order_using", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def order_using(spark, sf_dir):
    """ORDER BY c_acctbal USING >, c_custkey USING <"""
    keys = [F.col(c).asc() if pg.ascending(op) else F.col(c).desc() for c, op in (("c_acctbal", ">"), ("c_custkey", "<"))]
    top = Lake(spark, sf_dir).customer.orderBy(*keys).limit(20)
    from pyspark.sql import Window

    return top.select("c_custkey", F.row_number().over(Window.orderBy(*keys)).cast("bigint").alias("place"))


@plans.query("q_clocks", "SELECT count(*) AS n, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f FROM nation")
def clocks(spark, sf_dir):
    now = F.now()
    ok = [pg.clock_timestamp() >= F.lit("2020-01-01").cast("timestamp"), (pg.statement_timestamp() == now) & (pg.transaction_timestamp() == F.current_timestamp()), F.current_date() == F.to_date(now), pg.localtime().rlike("^[0-2][0-9]:[0-5][0-9]:"), pg.timeofday().rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d\d "), F.localtimestamp() == now.cast("timestamp_ntz")]
    return Lake(spark, sf_dir).nation.select(*(x.alias(k) for x, k in zip(ok, "abcdef", strict=True))).agg(F.count("*").alias("n"), *(F.bool_and(k).alias(k) for k in "abcdef"))


@plans.query("q_current_time", "SELECT count(*) AS n, true AS t FROM region")
def current_time(spark, sf_dir):
    return Lake(spark, sf_dir).region.select(F.current_time().cast("string").rlike("^[0-2][0-9]:").alias("t")).agg(F.count("*").alias("n"), F.bool_and("t").alias("t"))


_Y, _M, _D = "CAST(extract(year FROM o_orderdate) AS BIGINT)", "CAST(extract(month FROM o_orderdate) AS BIGINT)", "CAST(extract(day FROM o_orderdate) AS BIGINT)"


@plans.query("q_make_times", f"SELECT o_orderkey, CAST(make_date({_Y}, {_M}, 1) AS TIMESTAMP) AS d, '08:' || lpad(CAST({_D} AS VARCHAR), 2, '0') || ':05.5' AS t, make_timestamp({_Y}, {_M}, {_D}, 10, 30, 15.0) AS s, make_timestamp({_Y}, {_M}, {_D}, 12, 0, 0.0) - INTERVAL 9 HOUR AS z, o_orderdate + INTERVAL 14 MONTH + INTERVAL 10 DAY + INTERVAL 3 HOUR AS i, isfinite(o_orderdate) AS f FROM orders")
def make_times(spark, sf_dir):
    y, m, d = (part("o_orderdate").cast("int") for part in (F.year, F.month, F.day))
    return Lake(spark, sf_dir).orders.select(
        "o_orderkey", pg.make_date(y, m, F.lit(1)).cast("timestamp_ntz").alias("d"), pg.make_time(F.lit(8), d, F.lit(5.5)).alias("t"), pg.make_timestamp(y, m, d, F.lit(10), F.lit(30), F.lit(15)).alias("s"),
        pg.make_timestamptz(y, m, d, F.lit(12), F.lit(0), F.lit(0), "Asia/Tokyo").cast("timestamp_ntz").alias("z"), (F.col("o_orderdate").cast("timestamp_ntz") + pg.make_interval(years=1, months=2, weeks=1, days=3, hours=3)).alias("i"), pg.isfinite("o_orderdate").alias("f"),
    )


@plans.query("q_parse_times", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d, CAST(o_orderdate AS TIMESTAMP) AS t, CAST(o_orderdate AS TIMESTAMP) AS e, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 9 HOUR AS z FROM orders")
def parse_times(spark, sf_dir):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    ntz = lambda c: c.cast("timestamp_ntz")
    return Lake(spark, sf_dir).orders.select("o_orderkey", ntz(pg.to_date(day, "DD/MM/YYYY")).alias("d"), ntz(pg.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "YYYY-MM-DD HH24:MI:SS")).alias("t"), ntz(pg.to_timestamp(F.unix_seconds(at.cast("timestamp")))).alias("e"), ntz(pg.at_time_zone(at, "Asia/Tokyo")).alias("z"))


@plans.query("q_age", "SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2000-03-01') AS VARCHAR) || ' years ' || CAST(date_sub('month', CAST(o_orderdate AS DATE), DATE '2000-03-01') % 12 AS VARCHAR) || ' mons 0 days' AS a FROM orders WHERE extract(day FROM o_orderdate) = 1 AND o_orderdate < DATE '2000-03-01'")
def age(spark, sf_dir):
    return Lake(spark, sf_dir).orders.filter("day(o_orderdate) = 1 and o_orderdate < date'2000-03-01'").select("o_orderkey", pg.age(F.lit("2000-03-01").cast("date"), F.to_date("o_orderdate")).alias("a"))


@plans.query("q_justify", "SELECT p_partkey, CAST((p_size * 10 + p_partkey * 5 // 24) // 30 AS INTEGER) AS months, CAST((p_size * 10 + p_partkey * 5 // 24) % 30 AS INTEGER) AS days, CAST(p_partkey * 5 % 24 * 3600 AS BIGINT) AS seconds, CAST(p_partkey * 5 // 24 AS BIGINT) AS only_days, CAST(p_size * 10 // 30 AS INTEGER) AS only_months FROM part")
def justify(spark, sf_dir):
    """justify_interval, and justify_hours and justify_days, which are its halves."""
    whole = pg.justify(F.lit(0), F.col("p_size") * 10, F.col("p_partkey") * 18000)
    rows = Lake(spark, sf_dir).part.select("p_partkey", whole.alias("j"), pg.justify(F.lit(0), F.lit(0), F.col("p_partkey") * 18000).alias("justify_hours"), pg.justify(F.lit(0), F.col("p_size") * 10, F.lit(0)).alias("justify_days"))
    hours = F.col("justify_hours.months") * 30 + F.col("justify_hours.days")
    return rows.select("p_partkey", "j.months", "j.days", F.col("j.seconds").cast("bigint").alias("seconds"), hours.cast("bigint").alias("only_days"), F.col("justify_days.months").alias("only_months"))


_W = "string_split(p_name, ' ')"


@plans.query("q_array_building", f"SELECT p_partkey, list_concat({_W}, ['x']) AS cat, list_prepend('first', {_W}) AS pre, list_filter({_W}, lambda w: w <> 'lemon') AS rem, list_transform({_W}, lambda w: CASE WHEN w = 'lemon' THEN 'lime' ELSE w END) AS rep, [7, 7, 7] AS fill, list_filter(list_transform({_W}, lambda w, i: CASE WHEN w = {_W}[1] THEN i END), lambda i: i IS NOT NULL) AS pos FROM part")
def array_building(spark, sf_dir):
    w = F.split("p_name", " ")
    return Lake(spark, sf_dir).part.select(
        "p_partkey", pg.array_cat(w, F.array(F.lit("x"))).alias("cat"), pg.array_prepend(F.lit("first"), w).alias("pre"), pg.array_remove(w, "lemon").alias("rem"), pg.array_replace(w, "lemon", "lime").alias("rep"),
        pg.array_fill(7, 3).alias("fill"), F.expr("filter(transform(split(p_name, ' '), (w, i) -> if(w = split(p_name, ' ')[0], i + 1, null)), i -> i is not null)").alias("pos"),
    )


@plans.query("q_array_positions", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [1, 3] WHEN p_size % 3 = 1 THEN [2] ELSE [4] END AS p FROM part")
def array_positions(spark, sf_dir):
    a = F.array(F.col("p_size") % 3, F.col("p_size") % 3 - 1, F.col("p_size") % 3, F.col("p_size") % 3 - 2)
    return Lake(spark, sf_dir).part.select("p_partkey", pg.array_positions(a, 0).alias("p"))


@plans.query("q_array_measures", f"SELECT p_partkey, 1 AS lo, CAST(len({_W}) AS INTEGER) AS hi, 1 AS nd, CAST(len({_W}) AS INTEGER) AS card, CAST(len({_W}) * 2 AS INTEGER) AS card2, 2 AS hi1, true AS shuffled, true AS sampled, ['mid', 'high'] AS labels FROM part")
def array_measures(spark, sf_dir):
    w = F.split("p_name", " ")
    two = F.array(w, w)
    return Lake(spark, sf_dir).part.select(
        "p_partkey", pg.array_lower(w).alias("lo"), pg.array_upper(w).alias("hi"), pg.array_ndims(w).alias("nd"), pg.cardinality(w).alias("card"), pg.cardinality(two, 2).alias("card2"), pg.array_upper(two).alias("hi1"),
        (F.sort_array(pg.array_shuffle(w)) == F.sort_array(w)).alias("shuffled"), (F.size(F.array_intersect(pg.array_sample(w, 1), w)) == 1).alias("sampled"), pg.enum_range(["low", "mid", "high"], "mid").alias("labels"),
    )


plans.sql("q_variances", "SELECT l_returnflag, round(covar_samp(l_quantity, l_tax), 6) AS cs, every(l_quantity > 0) AS ev, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 5) AS vs, round(variance(l_quantity), 5) AS va FROM {lineitem} GROUP BY l_returnflag",
          "SELECT l_returnflag, round(covar_samp(l_quantity, l_tax), 6) AS cs, bool_and(l_quantity > 0) AS ev, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 5) AS vs, round(variance(l_quantity), 5) AS va FROM lineitem GROUP BY l_returnflag")
plans.sql("q_regression_sums", "SELECT l_returnflag, round(regr_avgx(l_quantity, l_tax), 9) AS ax, round(regr_avgy(l_quantity, l_tax), 6) AS ay, round(regr_sxx(l_quantity, l_tax), 5) AS sxx, round(regr_sxy(l_quantity, l_tax), 4) AS sxy, round(regr_syy(l_quantity, l_tax) / 1000, 4) AS syy FROM {lineitem} GROUP BY l_returnflag")
