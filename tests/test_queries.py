"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quillstack.plans import load, registry

load()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(registry.SQL[name]).select(*[f'"{c}"' for c in cols]).fetchall()
    got = df.select(*cols).collect()
    assert sorted((plain(tuple(r)) for r in got), key=repr) == sorted(map(plain, want), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["bm25_topk", "vector_topk", "rrf_hybrid", "subject_mine", "mcnemar_pairs"])
def test_stays_in_the_jvm(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
