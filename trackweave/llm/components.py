"""Connected components by alternating large-star and small-star steps; every step is a minimum per node and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import Workspace

ROUNDS = 60


def components(work: Workspace, edges: DataFrame, tag: str) -> DataFrame:
    """edges (a, b: long, not null) -> (node, root): for each node with an edge the least node it reaches.

    Joins stand on tables that were written, so that adaptive execution can split a node that has very many edges.
    """

    def star(e: DataFrame, k: str, large: bool) -> DataFrame:
        near = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            near = near.unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            near = near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = work.write(near.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{tag}-m{k}")
        met = near.join(least.withColumnRenamed("u", "u2"), F.col("u") == F.col("u2"))
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return work.write(out.where("a <> b").distinct(), f"{tag}-e{k}")

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = work.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{tag}-e")
    seen, used = None, [f"{tag}-e"]
    for k in range(ROUNDS):
        e = star(star(e, f"{k}l", True), f"{k}s", False)
        now = sign(e)
        work.drop(*used, f"{tag}-m{k}l", f"{tag}-m{k}s", f"{tag}-e{k}l")
        used = [f"{tag}-e{k}s"]
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
    raise RuntimeError("components did not settle")
