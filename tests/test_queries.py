"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import math
import os

import duckdb
import pytest

from corvane.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: These take long on one machine; test_operators.py tests what they call on small separated data.
SLOW = {"min_cluster_filter", "cluster_by_condition", "compare_runs", "select_k"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def text(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.7g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(text, v)) + "]"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(tuple(text(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(text(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and all(len(r) == len(rows[0]) for r in rows) and any(v is not None for v in rows[0])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
