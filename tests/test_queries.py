"""Every library query against its SQL in DuckDB, on the smallest dataset."""

import math

import duckdb
import pytest

from quillspan.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that may find nothing in so little data.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert rows or name in EMPTY, "a query that finds nothing shows nothing"
    if name not in ORACLE_SQL:
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert rows == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
