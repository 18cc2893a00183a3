"""Every registered query of the reference's own operators against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from quillon.plans.registry import ORACLES, QUERIES
from quillon.session import TABLES


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal)):
        return float(x)
    if isinstance(x, float):
        return x if math.isfinite(x) else str(x)
    if isinstance(x, datetime.date) and not isinstance(x, datetime.datetime):
        return datetime.datetime(x.year, x.month, x.day)
    return x


def kind(name: str) -> str:
    name = name.lower()
    for group, words in {"whole": ("int", "long", "short", "byte"), "double": ("double", "float"), "decimal": ("decimal",), "text": ("varchar", "string"), "time": ("timestamp", "date"), "truth": ("bool",)}.items():
        if any(w in name for w in words):
            return group
    return name


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def test_every_query_has_its_counterpart():
    assert set(QUERIES) - set(ORACLES) == {"q_tablesample"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    kinds = {d[0]: kind(str(d[1])) for d in got.description}
    assert sorted(df.columns) == sorted(columns)
    assert {c: kind(t) for c, t in df.dtypes} == kinds
    order = sorted(columns)
    want = sorted((tuple(value(dict(zip(columns, r, strict=True))[c]) for c in order) for r in got.fetchall()), key=repr)
    have = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a == b


def test_sample_repeats_itself_and_is_about_a_tenth(spark, sf_dir):
    a = QUERIES["q_tablesample"](spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert a == QUERIES["q_tablesample"](spark, sf_dir).collect() and 0.05 * n < len(a) < 0.15 * n
