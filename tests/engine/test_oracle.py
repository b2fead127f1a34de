"""Every query that has SQL gives DuckDB's rows, at two scales."""

import math

import duckdb
import pytest

from trackweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([[normal(r[i]) for i in order] for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    got = catalog.queries()[name](spark, sf)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [list(r) for r in got.collect()]) == rows(columns, [list(r) for r in want.fetchall()])
