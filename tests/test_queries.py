"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"feature_vectors", "train_quality_model", "url_clusters"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - SLOW))
def test_query(spark, sf, duck, name):
    df = engine.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in engine.ORACLE_SQL:
        return
    want = duck.sql(engine.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted((tuple(map(plain, r)) for r in want.project(listed).fetchall()), key=repr)


def test_entry_lists_all():
    assert set(engine.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_site_discovery_reads_all_orders(spark, tmp_path):
    rows = [(k, 1 if k < 5 else 2) for k in range(1, 8)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted((r.wave, r.place, r.url) for r in engine.QUERIES["site_discovery"](spark, str(tmp_path)).collect())
    assert got == [(0, 1, "c1"), *((1, k + 1, f"o{k}") for k in range(1, 5)), (2, 6, "c2"), *((3, k + 2, f"o{k}") for k in range(5, 8))]
