"""Every training-data query that SQL can express, against its SQL in DuckDB."""

import duckdb
import pytest

from quillon.llm.queries import ORACLES, QUERIES
from quillon.session import TABLES
from tests.test_queries import kind, value


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, name, scale):
    where = f"/root/testdata/{scale}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    got = con.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    df = QUERIES[name](spark, where)
    assert sorted(df.columns) == sorted(columns)
    assert {c: kind(t) for c, t in df.dtypes} == {d[0]: kind(str(d[1])) for d in got.description}
    order = sorted(columns)
    want = sorted((tuple(value(dict(zip(columns, r, strict=True))[c]) for c in order) for r in got.fetchall()), key=repr)
    have = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
    assert have == want
