"""Pairs of tracks, folders and images, with similarities, verdicts and reasons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.config import Thresholds
from trackweave.functions.vectors import color_similarity, dot, element_sums, gathered, overlap

BLOCK, TILE = 16384, 1024
KEPT = ["n", "proto", "proto_up", "proto_lo", "frames"]


def side(tracks: DataFrame, keys: dict[str, str], mark: str) -> DataFrame:
    return tracks.select(*[F.col(k).alias(v) for k, v in keys.items()], *[F.col(c).alias(f"{c}{mark}") for c in KEPT])


def scored(pairs: DataFrame) -> DataFrame:
    sims = {"reid_sim": dot("proto1", "proto2"), "color_sim": color_similarity("proto_up1", "proto_lo1", "proto_up2", "proto_lo2"), "frame_overlap": overlap("frames1", "frames2").cast("long")}
    return pairs.withColumns(sims)


def within_folders(protos: DataFrame, t: Thresholds) -> DataFrame:
    """Track pairs a < b of a folder, with the split verdict."""
    one, two = side(protos, {"folder": "folder", "local_id": "track_a"}, "1"), side(protos, {"folder": "folder", "local_id": "track_b"}, "2")
    met = scored(one.join(two, "folder").where("track_a < track_b"))
    good = (F.col("reid_sim") >= t.split_reid) & (F.col("color_sim") >= t.split_color)
    return met.select("folder", "track_a", "track_b", "reid_sim", "color_sim", "frame_overlap", F.lit(t.split_reid).alias("split_reid_threshold"), F.lit(t.split_color).alias("split_color_threshold"), F.when(good, "MERGED").otherwise("SPLIT").alias("verdict"))


def compared(specs: DataFrame, groups: DataFrame, t: Thresholds, use_large: bool) -> DataFrame:
    """Folder pairs of a spec, with the merge verdict and its reasons in a fixed order."""
    one, two = side(groups, {"folder": "folder1"}, "1"), side(groups, {"folder": "folder2"}, "2")
    met = scored(specs.join(one, "folder1").join(two, "folder2"))
    large = (F.greatest("n1", "n2") >= t.large_size) & F.lit(use_large)
    met = met.withColumns({"reid_threshold": F.when(large, t.large_reid).otherwise(t.merge_reid), "color_threshold": F.when(large, t.large_color).otherwise(t.merge_color), "mode": F.when(large, "LARGE").otherwise("NORMAL")})
    why = F.concat_ws(",", F.when(F.col("frame_overlap") > t.max_overlap, "frame_overlap"), F.when(F.col("reid_sim") < F.col("reid_threshold"), "reid_below"), F.when(F.col("color_sim") < F.col("color_threshold"), "color_below"))
    return met.withColumn("reasons", F.when(why == "", "ok").otherwise(why)).select(
        "spec", "folder1", "folder2", F.col("n1").alias("folder1_count"), F.col("n2").alias("folder2_count"), "reid_sim", "color_sim", "frame_overlap", "reid_threshold", "color_threshold",
        F.lit(t.max_overlap).alias("max_frame_overlap"), "mode", (F.col("reasons") == "ok").alias("can_merge"), "reasons", F.lit("ok").alias("status"),
    )


def across_folders(specs: DataFrame, protos: DataFrame, t: Thresholds) -> DataFrame:
    """Track pairs of a spec's two folders; the verdict ignores shared frames."""
    one, two = side(protos, {"folder": "folder1", "local_id": "track1"}, "1"), side(protos, {"folder": "folder2", "local_id": "track2"}, "2")
    met = scored(specs.join(one, "folder1").join(two, "folder2"))
    good = (F.col("reid_sim") >= t.merge_reid) & (F.col("color_sim") >= t.merge_color)
    return met.select("spec", "folder1", "folder2", "track1", "track2", "reid_sim", "color_sim", "frame_overlap", F.lit(t.merge_reid).alias("reid_threshold"), F.lit(t.merge_color).alias("color_threshold"), F.when(good, "MATCH").otherwise("NO").alias("verdict"))


def image_pairs(specs: DataFrame, crops: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Cosines of all images of a spec's two folders, where that is at most `most` pairs; larger specs give a row with a note."""
    sizes = crops.groupBy(F.col("folder").alias("f")).agg(F.count("*").alias("k"))
    s = specs.join(sizes.withColumnsRenamed({"f": "folder1", "k": "k1"}), "folder1").join(sizes.withColumnsRenamed({"f": "folder2", "k": "k2"}), "folder2")
    s = s.withColumn("fits", F.col("k1") * F.col("k2") <= most)
    one = crops.select(F.col("folder").alias("folder1"), F.col("crop_id").alias("image1"), F.col("emb").alias("emb1"))
    two = crops.select(F.col("folder").alias("folder2"), F.col("crop_id").alias("image2"), F.col("emb").alias("emb2"))
    met = s.where("fits").join(one, "folder1").join(two, "folder2").select("spec", "folder1", "folder2", "image1", "image2", dot("emb1", "emb2").alias("sim"))
    noted = s.where("not fits").select("spec", "folder1", "folder2", F.lit("skipped: too many pairs").alias("note"))
    return met.withColumn("note", F.lit(None).cast("string")).unionByName(noted, allowMissingColumns=True)


def top_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar image pairs of each spec; ties go to the lower ids; noted rows stay."""
    from pyspark.sql import Window

    order = Window.partitionBy("spec", "folder1", "folder2").orderBy(F.desc("sim"), "image1", "image2")
    return pairs.withColumn("tw_rank", F.row_number().over(order)).where(f"tw_rank <= {int(k)} or note is not null").drop("tw_rank")


def image_range(specs: DataFrame, crops: DataFrame, size: int) -> DataFrame:
    """Least, greatest and mean cosine of all images of a spec's two folders, however many: the mean from sums, the others by blocks of both folders."""
    crops = crops.where("emb is not null")
    sums = crops.groupBy(F.col("folder").alias("f")).agg(F.count("*").alias("k"), *element_sums("emb", size, "e")).select("f", "k", gathered("e", size).alias("s"))
    one, two = (sums.withColumnsRenamed({"f": f"folder{i}", "k": f"k{i}", "s": f"s{i}"}) for i in (1, 2))
    means = specs.distinct().join(one, "folder1").join(two, "folder2").withColumn("mean_sim", dot("s1", "s2") / (F.col("k1").cast("double") * F.col("k2")))
    s = means.select("spec", "folder1", "folder2", F.ceil(F.col("k1") / BLOCK).alias("n1"), F.ceil(F.col("k2") / BLOCK).alias("n2"))

    def dealt(own: str, other: str) -> DataFrame:
        """Images of one side, once for each block of the other."""
        e = s.join(crops.select(F.col("folder").alias(f"folder{own}"), "crop_id", "emb"), f"folder{own}")
        e = e.withColumn(f"b{own}", F.pmod(F.xxhash64("crop_id"), F.col(f"n{own}"))).withColumn(f"b{other}", F.explode(F.expr(f"sequence(0L, n{other} - 1)")))
        return e.select("spec", "folder1", "folder2", "b1", "b2", F.lit(int(own)).alias("side"), "emb")

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        emb = table["emb"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        side = table["side"].to_numpy()
        x, y = emb[side == 1], emb[side == 2]
        low, high = [], []
        for i in range(0, len(x), TILE):
            for j in range(0, len(y), TILE):
                sim = x[i : i + TILE] @ y[j : j + TILE].T
                low.append(sim.min())
                high.append(sim.max())
        spec, folder1, folder2 = (k.as_py() for k in key[:3])
        return pa.table({"spec": [spec] * bool(low), "folder1": pa.array([folder1] * bool(low), pa.int32()), "folder2": pa.array([folder2] * bool(low), pa.int32()), "low": [min(low)] if low else pa.array([], pa.float64()), "high": [max(high)] if low else pa.array([], pa.float64())})

    keys = ["spec", "folder1", "folder2"]
    ends = dealt("1", "2").unionByName(dealt("2", "1")).groupBy(*keys, "b1", "b2").applyInArrow(compared, "spec string, folder1 int, folder2 int, low double, high double")
    return ends.groupBy(*keys).agg(F.min("low").alias("min_sim"), F.max("high").alias("max_sim")).join(means.select(*keys, "mean_sim"), keys)
