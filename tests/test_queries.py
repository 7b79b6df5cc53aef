"""Every query with SQL gives that SQL's rows, over whole tables of the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def told(rows):
    return sorted([None if v is None or v != v else (f"{v:.9g}" if isinstance(v, float) else str(v)) for v in r] for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    order = sorted(got.columns)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == order
    assert told([r[c] for c in order] for r in got.collect()) == told([dict(zip(names, r))[c] for c in order] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["x", "y", "overlap", "coverage", "similarity"]


@pytest.mark.parametrize("name", ["tokenize_html_pages", "highlight_report"])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0
