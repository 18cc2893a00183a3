import hashlib
from collections import defaultdict

import pytest

from quillon.llm import mixing as M


def fill(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    """Water-filling by repeated clamping."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def table(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    return sizes


ROWS = [(i, "w " * (i * 7 % 23), [None, "a", "B", "é", "a"][i % 5]) for i in range(400)] + [(1000, None, "z"), (1001, "", "z"), (1002, "big " * 50_000, "y"), (None, "x x", "a")] + [(i, "w " * (i * 7 % 23), "a") for i in range(5)]


@pytest.mark.parametrize("bins", [5_000, 20])
def test_mix_meets_targets(spark, bins):
    docs = spark.createDataFrame([(*r, r[0]) for r in ROWS], "doc_id long, text string, source string, size long").repartition(3)
    got = M.mix(docs, rows_per_bin=bins).collect()
    sizes, expected = table(ROWS), fill(table(ROWS))
    assert len(got) == len(ROWS)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.repeats * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, size in sizes.items():
        assert abs(taken[s] - expected[s]) <= max(12, 0.02 * expected[s]) or s == "y"
    again = M.mix(docs.repartition(7), rows_per_bin=bins).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    copies = M.repeat(docs, rows_per_bin=bins)
    assert copies.columns == docs.columns and not any(r.repeats for r in got if not r.size)
    repeats = defaultdict(int)
    for r in got:
        repeats[r.doc_id, r.source, r["draw"]] += r.repeats
    key = M.seeded_hash(M.F.col("doc_id"), M.F.col("text"), 17).alias("draw")
    found = {(r.doc_id, r.source, r["draw"]): r["count"] for r in copies.groupBy("doc_id", "source", key).count().collect()}
    assert found == {k: n for k, n in repeats.items() if n}
    assert M.mix(docs.limit(0)).count() == 0


def test_hash_is_the_head_of_md5(spark):
    (r,) = spark.createDataFrame([(5, "é")], "doc_id long, text string").select(M.seeded_hash(M.F.col("doc_id"), M.F.col("text"), 17).alias("h")).collect()
    assert r.h == int(hashlib.md5(b"5:17:" + hashlib.md5("é".encode()).hexdigest().encode()).hexdigest()[:13], 16)


def test_null_and_repeated_ids_spread_over_bins(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i}", "a") for i in range(400)], "doc_id long, text string, source string")
    assert len({r["draw"] >> 46 for r in M.measured(docs, 17).collect()}) > 50


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 7, "d": 0}, {"a": 1}, {"a": 5, "b": 5, "c": 5, None: 500}, {"a": 0}])
def test_water_filling(spark, sizes):
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(sources).collect()}
    assert got == pytest.approx(fill(sizes)) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
