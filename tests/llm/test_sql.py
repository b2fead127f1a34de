"""Queries and their SQL return the same rows, on whole tables."""

import duckdb
import numpy as np
import pytest

from trackweave.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    told = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    rows = sorted(told.fetchall())
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == rows


def test_near_duplicates_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 8))
    rows = [(k, base[k % 60].tolist() if k < 90 else (base[k % 60] + 0.2 * rng.standard_normal(8)).tolist()) for k in range(200)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, []), (205, [1.0, 2.0]), (None, base[3].tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    columns = "vec_id, n_links, component_id, kept"
    told = con.sql(f"select {columns} from ({oracle.oracle_sql()['op9_embedding_near_dedup']})").fetchall()
    found = [tuple(r) for r in queries.queries()["op9_embedding_near_dedup"](spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sum(r[1] > 0 for r in told) > 100
    assert sorted(found, key=order) == sorted(told, key=order)
