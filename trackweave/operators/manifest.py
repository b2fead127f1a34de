"""A folder's manifest: its files, what came and went since the last one, its tracks and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators import tracks


def databases(crops: DataFrame, protos: DataFrame, groups: DataFrame, previous: DataFrame) -> DataFrame:
    """One row for each folder of crops (folder, file, frame, local_id, emb), as schema.MANIFEST names the fields; previous: (folder, files), null files where the old manifest does not parse.

    Sums come from the tracks' statistics. A manifest holds all names of its folder, so that a row grows with the folder: that is the format.
    """
    at = ["folder", "local_id"]
    own = crops.groupBy(*at).agg(F.sort_array(F.collect_list("file")).alias("files"))
    near = tracks.to_group(protos, groups, "folder").select(*at, "n", "frame_min", "frame_max", "reid_sim", "color_sim")
    entry = F.struct(
        F.col("n").alias("image_count"), "frame_min", "frame_max", *[F.col(f"{x}_sim").alias(f"{x}_similarity_to_track_proto") for x in ("mean", "min", "max")],
        F.col("reid_sim").alias("prototype_similarity_to_folder"), F.col("color_sim").alias("prototype_color_similarity_to_folder"), "files",
    )
    told = near.join(tracks.similarity_stats(crops, protos, at), at).join(own, at)
    told = told.groupBy("folder").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("local_id", entry.alias("e")))), lambda x: F.struct(x["local_id"].cast("string"), x["e"]))).alias("tracks"))
    sims = tracks.similarity_stats(crops, groups, ["folder"]).select("folder", F.struct(*[F.col(f"{x}_sim").alias(f"folder_proto_{x}_similarity") for x in ("mean", "min", "max")]).alias("folder_summary"))
    now = crops.groupBy("folder").agg(F.count("*").alias("image_count"), F.sort_array(F.collect_list(F.struct("file", "frame", "local_id"))).alias("images"), F.sort_array(F.collect_set("file")).alias("files"))
    old = previous.select("folder", F.col("files").alias("old"))
    out = now.join(sims, "folder").join(told, "folder").join(old, "folder", "left").withColumn("old", F.coalesce("old", F.array().cast("array<string>")))
    return out.withColumns({"added_files": F.array_except("files", "old"), "removed_files": F.array_sort(F.array_except("old", "files"))}).drop("old")
