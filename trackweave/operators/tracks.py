"""Crops to tracks and folders: additive statistics, prototypes, coherence, similarity statistics.

Statistics are sums and counts, so that tracks roll up to folders, and merged clusters to bigger ones, without touching crops again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.vectors import color_similarity, dot, element_sums, gathered, l2, norm, to_sum_one


def stats(crops: DataFrame, keys: list[str], size: int, half: int) -> DataFrame:
    """keys, n, sum_emb, sum_up, sum_lo, frames (distinct), frame_min, frame_max."""
    out = crops.groupBy(*keys).agg(
        F.count("*").alias("n"), *element_sums("emb", size, "e"), *element_sums("up", half, "u"), *element_sums("lo", half, "l"), F.sort_array(F.collect_set("frame")).alias("frames"), F.min("frame").alias("frame_min"), F.max("frame").alias("frame_max")
    )
    return out.select(*keys, "n", gathered("e", size).alias("sum_emb"), gathered("u", half).alias("sum_up"), gathered("l", half).alias("sum_lo"), "frames", F.coalesce("frame_min", F.lit(-1)).alias("frame_min"), F.coalesce("frame_max", F.lit(-1)).alias("frame_max"))


def rolled_up(tracks: DataFrame, keys: list[str], size: int, half: int) -> DataFrame:
    """Statistics of groups of tracks: sums of sums (weighted by crops, not by tracks)."""
    out = tracks.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("track_count"), *element_sums("sum_emb", size, "e"), *element_sums("sum_up", half, "u"), *element_sums("sum_lo", half, "l"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("frames")))).alias("frames"), F.min("frame_min").alias("frame_min"), F.max("frame_max").alias("frame_max"),
    )
    return out.select(*keys, "n", "track_count", gathered("e", size).alias("sum_emb"), gathered("u", half).alias("sum_up"), gathered("l", half).alias("sum_lo"), "frames", "frame_min", "frame_max")


def prototypes(tracks: DataFrame) -> DataFrame:
    """Adds proto, proto_up, proto_lo and coherence: the mean cosine to the own prototype is the mean vector's length."""
    mean = F.transform("sum_emb", lambda x: x / F.col("n"))
    return tracks.withColumn("mean_emb", mean).withColumns({"proto": l2("mean_emb"), "proto_up": to_sum_one("sum_up"), "proto_lo": to_sum_one("sum_lo"), "coherence": norm("mean_emb")}).drop("mean_emb")


def similarity_stats(crops: DataFrame, protos: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean_sim, min_sim, max_sim of crops to their group's prototype."""
    own = protos.select(*keys, "proto")
    sim = crops.select(*keys, "emb").join(own, keys).select(*keys, dot("emb", "proto").alias("sim"))
    return sim.groupBy(*keys).agg(F.avg("sim").alias("mean_sim"), F.min("sim").alias("min_sim"), F.max("sim").alias("max_sim"))


def pair_mean(tracks: DataFrame) -> DataFrame:
    """Mean cosine over ordered pairs of different unit vectors of a group, in closed form; null for one vector."""
    n = F.col("n").cast("double")
    return tracks.withColumn("pair_mean", F.when(F.col("n") > 1, (dot("sum_emb", "sum_emb") - F.col("sum_sq")) / (n * (n - 1))))


def to_group(tracks: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Similarity of each track's prototype to its group's."""
    g = groups.select(F.col(key).alias("g_key"), F.col("proto").alias("g_proto"), F.col("proto_up").alias("g_up"), F.col("proto_lo").alias("g_lo"))
    met = tracks.join(g, F.col(key) == F.col("g_key"))
    return met.withColumns({"reid_sim": dot("proto", "g_proto"), "color_sim": color_similarity("proto_up", "proto_lo", "g_up", "g_lo")}).drop("g_key", "g_proto", "g_up", "g_lo")
