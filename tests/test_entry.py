import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.QUERIES if q in entry.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or (a != a and b != b) or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1e-5)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    b = sorted(want.fetchall(), key=key)
    assert len(a) == len(b) and all(same(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
