"""Every query against its SQL on DuckDB, at the smallest scale."""

import duckdb
import pytest

from turnwise.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v) if v is not None else None


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    want = sorted(str([plain(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    catalog.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    rows = catalog.entry(spark, SF).collect()
    assert rows and {r.action for r in rows} <= {"OBJECT_MISSING", "ASK_WHICH_ONE", "LOCATION_MISSING", "RETURN_LOCATION"}
