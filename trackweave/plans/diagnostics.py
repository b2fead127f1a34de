"""Diagnostic and gate queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.config import FIXTURE, gap_frames
from trackweave.functions.vectors import dot, iou
from trackweave.operators import gates, geometry, pairs, tracks
from trackweave.sources import crops as names
from trackweave.sources import fixtures as fx

KEYS = ["folder", "local_id"]


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def track_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.stats(fx.crops(spark, sf), KEYS, fx.SIZE, fx.HALF)


def folders(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.prototypes(tracks.rolled_up(track_stats(spark, sf), ["folder"], fx.SIZE, fx.HALF))


def specs(spark: SparkSession) -> DataFrame:
    """The specs that parse, as pairs of folders."""
    rows = spark.createDataFrame([(s,) for s in fx.SPECS], "spec string")
    parsed = names.pair_specs(rows).where("status = 'ok'")
    return parsed.select("spec", F.col("left").cast("int").alias("folder1"), F.col("right").cast("int").alias("folder2"))


def intra_track_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return r6(pairs.within_folders(tracks.prototypes(track_stats(spark, sf)), FIXTURE), "reid_sim", "color_sim")


def track_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = tracks.prototypes(track_stats(spark, sf))
    sims = tracks.similarity_stats(fx.crops(spark, sf), p, KEYS)
    out = p.join(sims, KEYS).select("folder", F.col("local_id").alias("track_id"), F.col("n").alias("image_count"), "mean_sim", "min_sim", "max_sim", "coherence", "frame_min", "frame_max")
    return r6(out, "mean_sim", "min_sim", "max_sim", "coherence")


def folder_summary(spark: SparkSession, sf: str) -> DataFrame:
    own = folders(spark, sf)
    sims = tracks.similarity_stats(fx.crops(spark, sf), own, ["folder"])
    shared = pairs.within_folders(tracks.prototypes(track_stats(spark, sf)), FIXTURE).groupBy("folder").agg(F.count_if(F.col("frame_overlap") > 0).alias("overlap_pair_count"))
    out = own.join(sims, "folder").join(shared, "folder", "left")
    out = out.select(
        "folder", F.col("n").alias("image_count"), "track_count", "frame_min", "frame_max", F.col("mean_sim").alias("folder_sim_mean"), F.col("min_sim").alias("folder_sim_min"), F.col("max_sim").alias("folder_sim_max"),
        F.coalesce("overlap_pair_count", F.lit(0)).alias("overlap_pair_count"), F.lit("ok").alias("status"),
    )
    return r6(out, "folder_sim_mean", "folder_sim_min", "folder_sim_max")


def compare_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(pairs.compared(specs(spark), folders(spark, sf), FIXTURE, True), "reid_sim", "color_sim")


def compare_track_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return r6(pairs.across_folders(specs(spark), tracks.prototypes(track_stats(spark, sf)), FIXTURE), "reid_sim", "color_sim")


def compare_top_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return r6(pairs.top_pairs(pairs.image_pairs(specs(spark), fx.crops(spark, sf))), "sim")


def folder_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Files of folder f against those of folder f + 1's last sync, here the crops whose id is no multiple of 7 and those that are no multiple of 5."""
    c = fx.crops(spark, sf).select("folder", F.format_string("crop_%d.jpg", "crop_id").alias("file"), "crop_id")
    new, old = (c.where(F.col("crop_id") % k != 0).select("folder", "file") for k in (7, 5))
    added, removed = new.join(old, ["folder", "file"], "left_anti"), old.join(new, ["folder", "file"], "left_anti")
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed"))).groupBy("folder", "change").agg(F.count("*").alias("n"), F.min("file").alias("first_file"))


def track_to_folder_similarity(spark: SparkSession, sf: str) -> DataFrame:
    out = tracks.to_group(tracks.prototypes(track_stats(spark, sf)), folders(spark, sf), "folder")
    return r6(out.select("folder", "local_id", "reid_sim", "color_sim"), "reid_sim", "color_sim")


def pairwise_mean_offdiag(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.crops(spark, sf)
    squares = c.groupBy("folder").agg(F.sum(dot("emb", "emb")).alias("sum_sq"))
    out = tracks.pair_mean(tracks.stats(c, ["folder"], fx.SIZE, fx.HALF).join(squares, "folder"))
    return r6(out.select("folder", "n", "pair_mean"), "pair_mean")


def pairwise_range(spark: SparkSession, sf: str) -> DataFrame:
    return r6(pairs.image_range(specs(spark), fx.crops(spark, sf), fx.SIZE), "min_sim", "max_sim", "mean_sim")


def duplicate_frames(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.crops(spark, sf).where("frame >= 0")
    return c.groupBy("folder", "frame").agg(F.count("*").alias("n")).where("n > 1")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return fx.detections(spark, sf)


def save_gate(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).where(gates.save_ok()).select("det_id", "frame_idx", "local_id")


def reid_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A flag, not a filter: rows that fail go on."""
    return detections(spark, sf).select("det_id", F.coalesce(gates.reid_ok(), F.lit(False)).alias("reid_ok"))


def stage_a_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf)
    return d.select("det_id", F.coalesce(gates.stage_a_ok(), F.lit(False)).alias("stage_a"), F.coalesce(gates.stage_a_ok(area_check=True), F.lit(False)).alias("stage_a_area"), F.coalesce(gates.track_gate_ok(), F.lit(False)).alias("track_gate"))


def gate_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return gates.with_matrix(detections(spark, sf)).select("det_id", *gates.matrix())


def gate_pass_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gates.pass_counts(detections(spark, sf))


def failed_gate_list(spark: SparkSession, sf: str) -> DataFrame:
    return gates.failed_gates(detections(spark, sf)).select("det_id", "failed", "class")


def metric_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return gates.histogram(detections(spark, sf), "sharpness")


def label_gate_examples(spark: SparkSession, sf: str) -> DataFrame:
    return gates.examples(detections(spark, sf), "det_id")


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf).where("frame_idx >= 0").select("det_id", names.crop_name(F.col("frame_idx"), F.col("frame_idx") / 24.0, F.col("local_id")).alias("name"))
    odd = ["frame_000190_t_7.917.jpg", "frame_000190_t7.917_l5_1.jpg", "foo.jpg"]
    return d.unionByName(spark.createDataFrame([(-1 - i, n) for i, n in enumerate(odd)], "det_id long, name string"))


def crop_name_parse(spark: SparkSession, sf: str) -> DataFrame:
    return names.with_names(file_names(spark, sf))


def crop_name_format(spark: SparkSession, sf: str) -> DataFrame:
    return file_names(spark, sf)


def pair_spec_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in fx.LABELLED], "spec string")
    out = names.pair_specs(rows)
    return out.withColumns({"left_folder": names.folder_token(F.col("left")), "right_folder": names.folder_token(F.col("right"))})


def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.crops(spark, sf).select("folder", F.format_string("crop_%08d.jpg", "crop_id").alias("name"))
    return names.even_sample(c, 7, ["folder"], ["name"])


def every_n(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).where(F.pmod(F.col("frame_idx"), F.lit(3)) == 0).select("det_id", "frame_idx")


def bbox_iou(spark: SparkSession, sf: str) -> DataFrame:
    """Each detection's overlap with its track's next one."""
    w = Window.partitionBy("local_id").orderBy("frame_idx", "det_id")
    d = detections(spark, sf)
    for c in ("x1", "y1", "x2", "y2"):
        d = d.withColumn(f"a_{c}", F.col(c)).withColumn(f"b_{c}", F.lead(c).over(w))
    return d.where("b_x1 is not null").select("det_id", F.round(iou("a", "b"), 6).alias("iou"))


def safe_crop(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf).select("det_id", *[(F.col(c) - F.lit(s)).alias(c) for c, s in (("x1", 600), ("y1", 260), ("x2", 600), ("y2", 260))])
    return geometry.safe_crop(d, 320, 180).select("det_id", "cx1", "cy1", "cx2", "cy2")


def aspect_area(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf)
    return d.select("det_id", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.round("area_ratio", 9).alias("area_ratio"), F.round(gates.aspect(F.col("bw"), F.col("bh")), 6).alias("aspect"), F.round(F.col("frame_idx") / 24.0, 6).alias("seconds"))


def iou_pairs_same_frame(spark: SparkSession, sf: str) -> DataFrame:
    d = detections(spark, sf).withColumn("frame_idx", F.floor(F.col("frame_idx") / 6))
    out = geometry.same_frame_pairs(d.where("det_id % 2 = 0"), d.where("det_id % 2 = 1"), 0.1)
    return r6(out, "iou")


def identity_map_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.identity_map(fx.crops(spark, sf))


def identity_overlay(spark: SparkSession, sf: str) -> DataFrame:
    m = geometry.identity_map(fx.crops(spark, sf))
    d = detections(spark, sf).withColumn("local_id", F.col("local_id") % 5)
    return geometry.overlay(d, m).select("det_id", "frame_idx", "local_id", "person_id", "label", "review_label", "text_y", "review_y")


def online_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, places and colours drawn while linking; a frame's identities are those of the crops."""
    m = geometry.identity_map(fx.crops(spark, sf)).select(F.col("frame").alias("frame_idx"), "local_id", F.col("person_id").alias("gid"))
    d = fx.detections(spark, sf).select("det_id", "frame_idx", (F.col("local_id") % 5).alias("local_id"), "y1").join(m, ["frame_idx", "local_id"], "left")
    return geometry.online_labels(d).select("det_id", "local_text", "global_text", "local_y", "global_y", "b", "g", "r")


def deep_folder_report(spark: SparkSession, sf: str) -> DataFrame:
    """All that a folder's diagnosis tells, as rows: its tracks, how near each is to the folder, and its pairs of tracks."""
    line = lambda d, section, **c: d.select("folder", F.lit(section).alias("section"), *(c.get(k, F.lit(None)).cast(t).alias(k) for k, t in REPORT.items()))
    col = F.col
    own = line(track_summary(spark, sf), "track", a=col("track_id"), n=col("image_count"), low=col("min_sim"), high=col("max_sim"), value=col("mean_sim"))
    near = line(track_to_folder_similarity(spark, sf), "track to folder", a=col("local_id"), value=col("reid_sim"), high=col("color_sim"))
    met = line(intra_track_pairs(spark, sf), "pair", a=col("track_a"), b=col("track_b"), n=col("frame_overlap"), value=col("reid_sim"), high=col("color_sim"), told=col("verdict"))
    return own.unionAll(near).unionAll(met)


def deep_pair_report(spark: SparkSession, sf: str) -> DataFrame:
    """All that the diagnosis of two folders tells, as rows: the verdict, pairs of tracks, the most similar images, and the range over all images."""
    line = lambda d, section, **c: d.select("spec", "folder1", "folder2", F.lit(section).alias("section"), *(c.get(k, F.lit(None)).cast(t).alias(k) for k, t in REPORT.items()))
    col = F.col
    told = line(compare_summary(spark, sf), "verdict", n=col("frame_overlap"), value=col("reid_sim"), high=col("color_sim"), told=col("reasons"))
    met = line(compare_track_pairs(spark, sf), "pair", a=col("track1"), b=col("track2"), n=col("frame_overlap"), value=col("reid_sim"), high=col("color_sim"), told=col("verdict"))
    top = line(compare_top_pairs(spark, sf).where("image1 is not null"), "images", a=col("image1"), b=col("image2"), value=col("sim"))
    ends = line(pairwise_range(spark, sf), "range", low=col("min_sim"), high=col("max_sim"), value=col("mean_sim"))
    return told.unionAll(met).unionAll(top).unionAll(ends)


REPORT = {"a": "long", "b": "long", "n": "long", "low": "double", "high": "double", "value": "double", "told": "string"}


def id_hue(spark: SparkSession, sf: str) -> DataFrame:
    ids = detections(spark, sf).select("local_id").distinct()
    return ids.select("local_id", geometry.hue(F.col("local_id")).alias("hue"))


def top_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).groupBy("local_id").agg(F.count("*").alias("n"), F.countDistinct("frame_idx").alias("frames")).orderBy(F.desc("n"), "local_id").limit(10)


def frame_gap(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("local_id").orderBy("frame_idx", "det_id")
    return detections(spark, sf).select("det_id", "local_id", (F.col("frame_idx") - F.lag("frame_idx").over(w)).alias("gap"))


def gap_frames_query(spark: SparkSession, sf: str) -> DataFrame:
    """Recency window and stale limit for frame rates; none or 0 counts as 30."""
    rates = spark.createDataFrame([(0, 10.0), (1, 24.0), (2, 0.1), (3, 0.0), (4, None), (5, 29.97)], "video_id long, fps double")
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    short = F.greatest(F.lit(1.0), F.bround(fps * 3.0, 0))
    return rates.select("video_id", fps.alias("fps"), short.cast("long").alias("short_gap"), F.greatest(short * 2, F.bround(fps * 8.0, 0)).cast("long").alias("stale"))


assert gap_frames(10) == (30, 80)

QUERIES = {
    f.__name__: f
    for f in (
        intra_track_pairs, track_summary, folder_summary, compare_summary, compare_track_pairs, compare_top_pairs, folder_manifest_diff, track_to_folder_similarity, pairwise_mean_offdiag, pairwise_range,
        duplicate_frames, save_gate, reid_gate, stage_a_gate, gate_matrix, gate_pass_counts, failed_gate_list, metric_histogram, label_gate_examples, crop_name_parse, crop_name_format, pair_spec_parse, even_sample,
        every_n, bbox_iou, safe_crop, aspect_area, iou_pairs_same_frame, identity_map_last_wins, identity_overlay, online_overlay, deep_folder_report, deep_pair_report, id_hue, top_tracks, frame_gap,
    )
} | {"gap_frames": gap_frames_query}
