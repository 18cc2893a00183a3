"""Edge cases of the operators over small literals: nulls, ties, empty inputs, repeated rows."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from quillon.functions import pg, pgjson, pgxml, ranges
from quillon.operators import aggregates, catalog, compare, dml, graph, joins, recursive, schema, srf, windows
from quillon.sources import copy


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_series_follow_the_step(spark):
    got = one(spark, srf.series(1, 3), srf.series(3, 1), srf.series(3, 1, -1), srf.series(1, 6, 2), srf.series(F.lit(None), 3))
    assert got == ([1, 2, 3], [], [3, 2, 1], [1, 3, 5], None)
    assert [str(x) for x in one(spark, srf.decimal_series("0.5", "1.1", "0.3", 1))[0]] == ["0.5", "0.8", "1.1"]


def test_unnest_pads_with_nulls_and_drops_empty(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a"]), (2, [], [])], "k int, a array<int>, b array<string>")
    made = srf.unnest(df, {"x": F.col("a"), "y": F.col("b")}, ["k"], "ord")
    assert rows(made) == [(1, 1, 1, "a"), (1, 2, 2, None), (1, 3, 3, None)]


def test_integer_and_rounding_rules(spark):
    got = one(spark, pg.int_div(F.lit(-7), F.lit(2)), pg.pg_round(F.lit(2.5)), pg.pg_round(F.lit(-0.5)), pg.trunc(F.lit(-1.7)), pg.gcd(F.lit(-12), F.lit(18)), pg.gcd(F.lit(0), F.lit(0)), pg.lcm(F.lit(4), F.lit(6)))
    assert got == (-3, 2.0, -0.0, -1.0, 6, 0, 12)
    with pytest.raises(Exception, match="negative"):
        one(spark, pg.pg_sqrt(F.lit(-1.0)))


def test_special_functions(spark):
    import math

    for x in (-2.5, -0.3, 0.0, 0.4, 1.9, 2.6, 5.0):
        assert abs(one(spark, pg.erf(F.lit(x)))[0] - math.erf(x)) < 1e-12
    for x in (0.3, 1.0, 4.5, 20.0, -1.5):
        got = one(spark, pg.gamma(F.lit(x)), pg.lgamma(F.lit(x)))
        assert abs(got[0] / math.gamma(x) - 1) < 1e-10 and abs(got[1] - math.lgamma(x)) < 1e-10


def test_text_rules(spark):
    s = F.lit("hello")
    got = one(spark, pg.left(s, -2), pg.right(s, -2), pg.left(s, 9), pg.substr(s, 0, 2), pg.substr(s, -1, 2), pg.concat(F.lit("a"), F.lit(None), F.lit("b")), pg.initcap(F.lit("o'neil-smith x2y")))
    assert got == ("hel", "llo", "hello", "h", "", "ab", "O'Neil-Smith X2y")
    got = one(spark, pg.quote_ident(F.lit("a b")), pg.quote_literal(F.lit("it's")), pg.quote_nullable(F.lit(None).cast("string")), pg.chr_(F.lit(8364)), pg.unistr(F.lit(r"\0041\+00263A!")))
    assert got == ('"a b"', "'it''s'", "NULL", "€", "A☺!")
    assert one(spark, pg.string_to_array(F.lit(""), ","), pg.string_to_array(F.lit("a,,b"), ",", ""), pg.parse_ident(F.lit('App."My Table"'))) == ([], ["a", None, "b"], ["app", "My Table"])
    assert one(spark, pg.normalize(F.lit("e\u0301")), pg.is_normalized(F.lit("e\u0301"))) == ("\u00e9", False)


def test_pattern_rules(spark):
    s = F.lit("foobarbaz")
    got = one(spark, pg.regexp_replace(s, "b(..)", r"X\1Y"), pg.regexp_replace(s, "b(..)", r"X\1Y", "g"), pg.regexp_match(s, "(b.)(r)"), pg.similar_to(s, "%(bar|x)%"), pg.similar_to(s, "foo"))
    assert got == ("fooXarYbaz", "fooXarYXazY", ["ba", "r"], True, False)
    assert one(spark, pg.regexp_match(s, "q")) == (None,)


def test_three_valued_quantifiers(spark):
    a = F.array(F.lit(1), F.lit(None), F.lit(3))
    assert one(spark, pg.any_of(F.lit(3), "=", a), pg.any_of(F.lit(5), "=", a), pg.all_of(F.lit(5), ">", a), pg.all_of(F.lit(2), ">", a)) == (True, None, None, False)


def test_dates(spark):
    ts = F.lit("2001-02-18 20:38:40").cast("timestamp_ntz")
    got = one(spark, pg.extract("dow", ts), pg.extract("century", ts), pg.extract("decade", ts), pg.extract("isodow", ts), pg.extract("epoch", ts))
    assert got == (0, 21, 200, 7, 982528720.0)
    assert str(one(spark, pg.date_trunc("millennium", ts))[0]) == "2001-01-01 00:00:00" and str(one(spark, pg.date_bin(900, ts, "2001-01-01"))[0]) == "2001-02-18 20:30:00"
    assert one(spark, pg.age(F.lit("2001-04-10").cast("date"), F.lit("1957-06-13").cast("date"))) == ("43 years 9 mons 28 days",)
    assert one(spark, pg.overlaps(F.lit(1), F.lit(5), F.lit(7), F.lit(3)), pg.overlaps(F.lit(1), F.lit(3), F.lit(3), F.lit(4))) == (True, False)


def test_arrays(spark):
    a = F.array(F.lit(5), F.lit(None), F.lit(5))
    got = one(spark, pg.array_length(F.array().cast("array<int>")), pg.array_positions(a, 5), pg.array_position(a, 9), pg.array_at(a, 7), pg.array_at(a, 0), pg.array_slice(a, 0, 1), pg.array_replace(a, 5, 6))
    assert got == (None, [1, 3], None, None, None, [5], [6, None, 6])
    assert one(spark, pg.array_to_string(a, ","), pg.array_to_string(a, ",", "*")) == ("5,5", "5,*,5")


def test_ranges(spark):
    r = lambda a, b, how="[)": ranges.make(F.lit(a).cast("int"), F.lit(b).cast("int"), how, True)
    t = lambda c: ranges.text(c)
    assert one(spark, t(r(1, 5, "(]")), t(r(3, 3)), t(r(None, 4)), t(ranges.intersection(r(1, 5), r(3, 9))), t(ranges.union(r(1, 5), r(5, 9))), t(ranges.merge(r(1, 2), r(8, 9)))) == ("[2,6)", "empty", "(,4)", "[3,5)", "[1,9)", "[1,9)")
    assert one(spark, ranges.contains_value(r(1, 5), F.lit(5)), ranges.contains(r(None, 9), r(1, 3)), ranges.overlaps(r(1, 5), r(5, 6)), ranges.adjacent(r(1, 5), r(5, 6)), ranges.left_of(r(1, 5), r(5, 6)), ranges.not_right(r(1, 5), r(0, 6)), ranges.not_left(r(1, 5), r(2, 6))) == (False, True, False, True, True, True, False)
    with pytest.raises(Exception, match="contiguous"):
        one(spark, ranges.union(r(1, 2), r(4, 5)))
    assert [tuple(x) for x in one(spark, ranges.multirange(F.array(r(5, 8), r(1, 3), r(2, 4), r(6, 6))))[0]] == [(1, 4), (5, 8)]


def test_json_rules(spark):
    j = F.lit('{"a": {"b": [1, 2, {"c": null}]}, "d": "x"}')
    assert one(spark, pgjson.get(j, "a", "b"), pgjson.get_text(j, "d"), pgjson.get_text(j, "a", "b", 2, "c"), pgjson.get(j, "a", "b", -2)) == ('[1,2,{"c":null}]', "x", None, "2")
    assert one(spark, pgjson.contains(j, '{"a": {"b": [2]}}'), pgjson.contains(j, '{"d": "y"}'), pgjson.has_any(j, ["q", "d"]), pgjson.has_all(j, ["q", "d"]), pgjson.is_json(F.lit("{"), "object")) == (True, False, True, False, False)
    assert one(spark, pgjson.set_(j, ["a", "b", "0"], '"z"'), pgjson.strip_nulls(j), pgjson.path_query_array(j, "$.a.b[*] ? (@ > 1)"), pgjson.json_value(j, "$.d"), pgjson.typeof(F.lit("[1]"))) == ('{"a":{"b":["z",2,{"c":null}]},"d":"x"}', '{"a":{"b":[1,2,{}]},"d":"x"}', "[2]", "x", "array")


def test_xml_rules(spark):
    x = pgxml.element("a", {"k": F.lit('q"<'), "none": F.lit(None).cast("string")}, pgxml.forest(b=F.lit("1&2")))
    assert one(spark, x, pgxml.well_formed(x), pgxml.well_formed(F.lit("<a>")), pgxml.well_formed(F.lit("x<b/>"), document=False)) == ('<a k="q&quot;&lt;"><b>1&amp;2</b></a>', True, False, True)


def test_null_aware_anti_join(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    full, holed, empty = (spark.createDataFrame(x, "v int") for x in ([(1,)], [(1,), (None,)], []))
    assert [rows(joins.not_in(left, "k", v, "v")) for v in (full, holed)] == [[(2,)], []]
    assert joins.not_in(left, "k", empty, "v").count() == 3
    assert joins.quantified(left, "k", ">", "all", empty, "v").count() == 3 and joins.quantified(left, "k", ">", "any", empty, "v").count() == 0
    assert rows(joins.quantified(left, "k", ">=", "all", full, "v")) == [(1,), (2,)] and joins.quantified(left, "k", ">=", "all", holed, "v").count() == 0


def test_range_joins_find_each_pair_once(spark):
    points = spark.createDataFrame([(float(i),) for i in range(-5, 30)], "p double")
    spans = spark.createDataFrame([(0.0, 12.5), (3.0, 3.0), (-4.0, 1.0), (20.0, 21.0)], "lo double, hi double")
    want = sorted((p, lo, hi) for (p,) in rows(points) for lo, hi in rows(spans) if lo <= p < hi)
    assert sorted(rows(joins.range_join(points, spans, "p", "lo", "hi", 5.0))) == want
    other = spark.createDataFrame([(-9.0, 0.5), (12.0, 40.0)], "a double, b double")
    want = sorted((lo, hi, a, b) for lo, hi in rows(spans) for a, b in rows(other) if lo < hi and lo < b and a < hi)
    assert sorted(rows(joins.overlap_join(spans, other, ("lo", "hi"), ("a", "b"), 5.0))) == want


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 10, "z")], "k int, rt int, v string")
    assert rows(joins.asof_join(left, right, ["k"], "t", "rt", ["v"])) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_asof_matches_neither_null_keys_nor_null_times(spark):
    left = spark.createDataFrame([(1, 5), (None, 5), (1, None), (1, 100), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, None, "n"), (None, 1, "x"), (1, 4, "a"), (1, 60, "b"), (2, 2, "z")], "k int, rt int, v string")
    want = [(None, 5, None), (1, None, None), (1, 5, "a"), (1, 100, "b"), (2, 1, None)]
    for width in (1.0, 7.0, 1000.0):
        assert sorted(rows(joins.asof_join(left, right, ["k"], "t", "rt", ["v"], width)), key=str) == sorted(want, key=str)


def test_asof_equals_a_loop(spark):
    rng = random.Random(5)
    left = [(rng.choice("ab"), rng.randrange(400)) for _ in range(150)]
    right = [(k, t, f"{k}{t}") for k, t in {(rng.choice("ab"), rng.randrange(400)) for _ in range(40)}]
    got = rows(joins.asof_join(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, rt long, v string"), ["k"], "t", "rt", ["v"], 50.0))
    assert sorted(got, key=str) == sorted(((k, t, max(((rt, v) for j, rt, v in right if j == k and rt <= t), default=(0, None))[1]) for k, t in left), key=str)


def test_range_joins_of_any_length_equal_loops(spark):
    rng = random.Random(6)
    spans = [(float(a), a + rng.choice([0.0, 0.3, 2.0, 40.0, 1e6])) for a in (rng.uniform(-100, 100) for _ in range(60))]
    points = [(rng.uniform(-200, 200),) for _ in range(50)] + [(None,)]
    p, s = spark.createDataFrame(points, "p double"), spark.createDataFrame(spans, "lo double, hi double")
    pairs = [(x, lo, hi) for (x,) in points for lo, hi in spans if x is not None and lo <= x < hi]
    assert sorted(rows(joins.range_join(p, s, "p", "lo", "hi", 2.0))) == sorted(pairs)
    lone = [(x, None, None) for (x,) in points if not any(x == y for y, _, _ in pairs)]
    assert sorted(rows(joins.range_join(p, s, "p", "lo", "hi", 2.0, "left")), key=str) == sorted(pairs + lone, key=str)
    other = [(a, a + rng.choice([0.1, 5.0, 1e5])) for a in (rng.uniform(-100, 100) for _ in range(20))]
    want = [(lo, hi, a, b) for lo, hi in spans for a, b in other if lo < hi and lo < b and a < hi]
    assert sorted(rows(joins.overlap_join(s, spark.createDataFrame(other, "a double, b double"), ("lo", "hi"), ("a", "b"), 2.0))) == sorted(want)


def test_components_equal_mutual_reach(spark):
    from quillon.operators import graph

    rng = random.Random(7)
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}", "soft") for _ in range(55)]
    reach = {a: {a} for e in edges for a in e[:2]}
    for _ in range(len(reach)):
        for a, b, _ in edges:
            reach[a] |= reach[b]
    want = {(a, min(b for b in reach[a] if a in reach[b])) for a in reach if any(b != a and a in reach[b] for b in reach[a])}
    assert set(rows(graph.components(spark.createDataFrame(edges, "src string, dst string, kind string")))) == want and want
    with pytest.raises(ValueError, match="cycles"):
        graph.levels(spark.createDataFrame([("a", "b", "hard"), ("b", "a", "hard")], "src string, dst string, kind string"), spark.createDataFrame([("a",), ("b",)], "key string"))


def test_closure_ends_with_nulls_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), (None, "a"), ("b", None), ("a", "b")], "src string, dst string")
    want = {(x, y) for x in ("a", "b", None) for y in ("a", "b", None)}
    assert set(rows(recursive.closure(edges))) == want


def test_newest_rows_over_batches(spark, tmp_path):
    from quillon.streaming import events

    write = events.upsert_sink(str(tmp_path / "t"), ["k"], "t")
    write(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "x")], "k int, t int, v string"), 0)
    write(spark.createDataFrame([(1, 3, "c"), (2, 4, "old")], "k int, t int, v string"), 1)
    assert rows(events.read_upserted(spark, str(tmp_path / "t"), ["k"], "t")) == [(1, 3, "c"), (2, 5, "x")]


def test_copy_text_keeps_its_delimiter(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b\\,c"), (2, None), (3, ""), (4, "x\ty"), (5, ",")], "k int, v string")
    copy.copy_to(df, str(tmp_path / "out"), "text", delimiter=",")
    assert rows(copy.copy_from(spark, str(tmp_path / "out"), "k int, v string", "text", delimiter=",")) == rows(df)


def test_references_of_statements():
    from quillon.operators import references as R

    found = lambda q: {(r["name"], r["how"]) for r in R.collect(q)}
    assert found("select 'from x' /* from y */ -- from z\n from w for update") == {("w", "relation")}
    assert found('with a(x) as (select 1), b as (select * from a) select * from b, "Big" c, lateral g(c.y)') == {("Big", "relation"), ("g", "function")}
    assert found("update t set a = s.b from s where t.a is distinct from s.c") == {("t", "relation"), ("s", "relation")}
    assert R.collect("") == R.check(None, {}, set()) == []


def test_sequences_have_no_gaps(spark):
    made = copy.nextval(spark.range(500).repartition(7), "n", ["id"], 10, -2)
    assert sorted(map(tuple, made.collect())) == [(i, 10 - 2 * i) for i in range(500)]


def test_aggregates_keep_nulls_and_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, None, 1), (1, "a", 3), (2, None, 1)], "k int, v string, o int")
    made = df.groupBy("k").agg(aggregates.array_agg("v", ["o"]).alias("a"), aggregates.string_agg("v", "-", ["o"]).alias("s"))
    assert rows(made) == [(1, [None, "b", "a"], "b-a"), (2, [None], None)]
    spans = spark.createDataFrame([("x", 1, 3), ("x", 3, 5), ("x", 7, 9), ("x", 8, 8), ("y", 1, 2)], "k string, lo int, hi int")
    assert rows(aggregates.range_agg(spans, ["k"], "lo", "hi")) == [("x", 1, 5), ("x", 7, 9), ("y", 1, 2)]
    assert len(aggregates.cube_sets(["a", "b"])) == 4 and aggregates.rollup_sets(["a"]) == [("a",), ()]


def test_ties_at_the_limit_stay(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 4), (5, 5)], "k int, v int")
    assert {r[0] for r in windows.with_ties(df, [F.col("v").desc_nulls_last()], 2).collect()} == {1, 2, 5}
    assert windows.with_ties(df, [F.col("v").desc_nulls_first()], 1).count() == 1 and windows.with_ties(df, [F.col("v").asc()], 0).count() == 0


def test_recursion_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert rows(recursive.reachable(edges, start)) == [(1,), (2,), (3,)]
    assert recursive.closure(edges).count() == 10
    found = recursive.paths(edges, start).orderBy("depth").collect()
    assert [(r.node, r.is_cycle) for r in found] == [(1, False), (2, False), (3, False), (1, True)]
    assert recursive.closure(edges.limit(0)).count() == 0


def _broadcast_rows(spark, after=-1):
    """Rows of all broadcasts in executions later than ``after``, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, total, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    found = store.executionsList()
    for i in range(found.size()):
        at = found.apply(i).executionId()
        last = max(last, at)
        if at <= after:
            continue
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for j in range(nodes.size()):
            if nodes.apply(j).name() != "BroadcastExchange":
                continue
            metrics = nodes.apply(j).metrics()
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total, last


@pytest.mark.parametrize("small", [65_536, 100])
def test_recursion_never_broadcasts_the_edges(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(recursive, "SMALL", small, raising=False)
    spark.range(2, 3000).selectExpr("id div 2 as src", "id as dst").write.parquet(str(tmp_path / "e"))
    edges, start = spark.read.parquet(str(tmp_path / "e")), spark.createDataFrame([(1,)], "node long")
    _, last = _broadcast_rows(spark)
    assert sorted(r[0] for r in recursive.reachable(edges, start).collect()) == list(range(2, 3000))
    sent, last = _broadcast_rows(spark, last)
    assert 0 < sent <= min(3000, 3 * small)  # each row found at most once; the edges have 2998 rows in each of 11 rounds
    assert recursive.paths(edges, start).count() == 2999
    assert 0 < _broadcast_rows(spark, last)[0] <= min(3000, 3 * small)


def test_fixpoint_knows_nulls_and_rows_of_many_columns(spark):
    step = {(None, 0): [("a", 1), (None, 1)], ("a", 1): [(None, 0), ("a", None)], ("a", None): [("a", 1), ("a", None)]}
    moves = spark.createDataFrame([(*a, *b) for a, to in step.items() for b in to], "a string, b int, c string, d int")
    made = recursive.fixpoint(
        spark.createDataFrame([(None, 0), (None, 0)], "k string, n int"),
        lambda f: f.join(moves, F.col("k").eqNullSafe(F.col("a")) & F.col("n").eqNullSafe(F.col("b"))).select(F.col("d").alias("n"), F.col("c").alias("k")),
    )
    assert sorted(map(tuple, made.collect()), key=str) == sorted([(None, 0), ("a", 1), (None, 1), ("a", None)], key=str)


def test_compare_by_keys_with_nulls(spark):
    a = spark.createDataFrame([(1, None, "x"), (None, 1, "y"), (3, 3, "z")], "k int, l int, v string")
    b = spark.createDataFrame([(1, None, "x"), (None, 1, None), (4, 4, "q")], "k int, l int, v string")
    got = {(r.k, r.l): (r.category, r.diffs and [tuple(d) for d in r.diffs]) for r in compare.compare(a, b, ["k", "l"]).collect()}
    assert got == {(1, None): ("Identical", []), (None, 1): ("Different", [("v", "y", None)]), (3, 3): ("OnlyInSource", None), (4, 4): ("OnlyInTarget", None)}
    assert compare.choose_key(None, [[], ["u"]]) == ["u"] and compare.choose_key(None) is None
    assert compare.topological_order(["c", "a", "b"], [("a", "b"), ("b", "c"), ("c", "a")]) == ["c", "b", "a"]


def test_merge_takes_the_first_clause_that_fits(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(1, "A"), (2, None), (9, "N"), (9, "M")], "k int, v string")
    made, changed = dml.merge(t, s, ["k"], [dml.When("matched", "nothing", F.col("s.v").isNull()), dml.When("matched", "update"), dml.When("missing", "insert"), dml.When("orphan", "delete")])
    assert rows(made) == [(1, "A"), (2, "b"), (9, "M")]
    assert sorted(r.action for r in changed.collect()) == ["delete", "insert", "update"]


def test_plan_puts_stubs_first_in_hard_cycles():
    changes = [{"id": i, "key": i, "phase": 75, "stub": i != "a"} for i in "abc"]
    assert graph.plan(changes, [("a", "b", "hard"), ("b", "a", "hard"), ("c", "a", "soft")]) == ["b", "a", "c"]
    assert graph.loop(["b", "a"], [("a", "b"), ("b", "a")]) == ["a", "b", "a"]


def test_canonical_text_spares_literals(spark):
    got = one(spark, schema.canonical(F.lit("SELECT  'A  b',  X::text\nFROM T ;")), schema.canonical(F.lit("(((a) > (b)))")), schema.canonical(F.lit("(a) > (b)")))
    assert got == ("select 'A  b',x from t", "(a)>(b)", "(a)>(b)")


def test_keys_and_references(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5), (None, 1)], "a int, b int")
    assert rows(catalog.key_violations(df, ["a", "b"])) == [(1, None, 2), (2, 5, 2), (None, 1, 1)]
    assert rows(catalog.unique_violations(df, ["a", "b"])) == [(2, 5, 2)] and catalog.unique_violations(df, ["a", "b"], nulls_distinct=False).count() == 2
    parent = spark.createDataFrame([(2, 5)], "x int, y int")
    keys = [("a", "x"), ("b", "y")]
    assert catalog.reference_violations(df, parent, keys).count() == 0 and catalog.reference_violations(df, parent, keys, full=True).count() == 3


@pytest.mark.parametrize("form", ["text", "csv", "binary"])
def test_copy_round_trip(spark, tmp_path, form):
    df = spark.createDataFrame([(1, "a\tb\\n"), (2, None), (3, 'say "x", y'), (4, "line\nbreak")] if form != "csv" else [(1, "a\tb"), (2, None), (3, 'say "x", y')], "k int, v string")
    copy.copy_to(df, str(tmp_path / "out"), form)
    assert rows(copy.copy_from(spark, str(tmp_path / "out"), "k int, v string", form)) == rows(df)


def test_copy_on_error_and_options(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,a\nx,b\n3,c\n")
    assert rows(copy.copy_from(spark, str(tmp_path / "in.csv"), "k int, v string", on_error="ignore", where=F.col("k") < 3)) == [(1, "a")]
    with pytest.raises(Exception, match="(?i)malformed"):
        copy.copy_from(spark, str(tmp_path / "in.csv"), "k int, v string").collect()
    with pytest.raises(ValueError, match="one-byte"):
        copy.copy_to(spark.range(1), str(tmp_path / "bad"), delimiter="ab")
    copy.copy_to(spark.createDataFrame([("a", "b")], "x string, y string"), str(tmp_path / "q"), force_quote=["y"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "q")).collect()] == ['a,"b"']


def test_tables_as_views(spark, tmp_path):
    path = str(tmp_path / "mv")
    assert copy.create_as(spark.range(3), path, with_data=False).count() == 0
    assert copy.refresh(spark.range(5), path).count() == 5


def test_packages(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, content string")
    manifest = copy.package_hashes(files.replace("2", "x")).filter("path <> 'd'").unionByName(spark.createDataFrame([("c", "0")], "path string, hash string"))
    assert rows(copy.verify_package(files, manifest)) == [("b", "changed"), ("c", "missing"), ("d", "extra")]


def test_identity_goes_on_after_the_largest(spark):
    made = copy.next_ids(spark.range(4).withColumn("n", F.lit(0)), "n", spark.createDataFrame([(41,)], "n int"))
    ids = [r.n for r in made.collect()]
    assert min(ids) == 42 and len(set(ids)) == 4


def test_events_as_a_stream(spark, tmp_path, sf_dir):
    from quillon.streaming import events

    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in")
    stream = events.read_folder(spark, str(tmp_path / "in"), source.schema)
    query = events.tumbling(stream, "ts", "1 hour", ["event_type"], "1 day").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("hours").select(F.col("start").cast("timestamp_ntz"), "event_type", "n")
    assert rows(got) == rows(events.tumbling(source, "ts", "1 hour", ["event_type"]).select("start", "event_type", "n"))
