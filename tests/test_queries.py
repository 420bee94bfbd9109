"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from fieldstrata import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow ones, checked at the next size by the same comparison elsewhere.
NO_SQL = [n for n in plans.QUERIES if n not in plans.ORACLES]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) and not isinstance(b, bool):
        return a == b or abs(a - b) <= 2e-5 * max(1.0, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=repr)
    r = db.execute(plans.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted([tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()], key=repr)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True)), next((a, b) for a, b in zip(got, want, strict=True) if a != b)


@pytest.mark.parametrize("name", NO_SQL)
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
