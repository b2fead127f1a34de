"""Queries about files, manifests and counts: what is written, looked up and reported beside the diagnostics."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.config import FIXTURE, Thresholds
from trackweave.functions.vectors import dot, ema_hist, ema_unit, total
from trackweave.operators import gates, pairs, tracks
from trackweave.plans import diagnostics as dg
from trackweave.plans.refine import destination
from trackweave.plans.sql import CROPS, DETECTIONS, FOLDERS, TRACKS, sims
from trackweave.sources import crops as names
from trackweave.sources import fixtures as fx

ALPHA, HIST_ALPHA = 0.20, 0.12  # fixed values: weights of a new crop in prototypes of vectors and of histograms
LEAST_TRACK, LEAST_CONF = 12, {f.name: f.default for f in fields(Thresholds)}["detection_confidence"]


def classed(spark: SparkSession, sf: str) -> DataFrame:
    """Detections with a class (every third is none of a person), a confidence, and a track id that some lack."""
    k = F.col("det_id")
    return fx.detections(spark, sf).withColumns({"cls": F.when(k % 3 == 2, 1).otherwise(0), "conf": (k * 41 % 1000) / 1000.0, "local_id": F.when(k % 11 != 0, F.col("local_id"))})


def detection_filter(spark: SparkSession, sf: str) -> DataFrame:
    return classed(spark, sf).where(gates.detection_ok()).select("det_id", "video_id", "frame_idx", "local_id", "x1", "y1", "x2", "y2")


def funnel_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each video: detections seen, kept by the detector's filter, saved, fit for linking, distinct tracks; one pass."""
    ok = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return classed(spark, sf).groupBy("video_id").agg(
        F.count("*").alias("seen"), ok(gates.detection_ok()).alias("detected"), ok(gates.detection_ok() & gates.save_ok()).alias("saved"),
        ok(gates.detection_ok() & ~gates.save_ok()).alias("filtered"), ok(gates.detection_ok() & gates.reid_ok()).alias("linkable"), F.countDistinct("local_id").alias("tracks"),
    )


def track_census(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of at least LEAST_TRACK detections, with their length in frames."""
    d = fx.detections(spark, sf).groupBy("video_id", "local_id").agg(F.count("*").alias("n"), F.countDistinct("frame_idx").alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
    return d.where(F.col("n") >= LEAST_TRACK)


def best_other_track(spark: SparkSession, sf: str) -> DataFrame:
    """For each track the other one of its folder that is most alike by reid + colour; the first of equals."""
    p = pairs.within_folders(tracks.prototypes(dg.track_stats(spark, sf)), FIXTURE).select("folder", "track_a", "track_b", "reid_sim", "color_sim", "frame_overlap")
    both = p.select("folder", F.col("track_a").alias("local_id"), F.col("track_b").alias("other"), "reid_sim", "color_sim", "frame_overlap").unionAll(
        p.select("folder", F.col("track_b").alias("local_id"), F.col("track_a").alias("other"), "reid_sim", "color_sim", "frame_overlap")
    )
    best = F.max(F.struct(F.round(F.col("reid_sim") + F.col("color_sim"), 9).alias("score"), (-F.col("other")).alias("less"), "other", "reid_sim", "color_sim", "frame_overlap")).alias("best")
    out = both.groupBy("folder", "local_id").agg(best).select("folder", "local_id", "best.other", "best.reid_sim", "best.color_sim", "best.frame_overlap", "best.score")
    return dg.r6(out, "reid_sim", "color_sim", "score")


def folder_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """What a folder's manifest says: counts, similarities to the folder's prototype, first and last file, and the files added and removed."""
    c = fx.crops(spark, sf).withColumn("file", F.format_string("crop_%08d.jpg", "crop_id"))
    own = c.groupBy("folder").agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"), F.count_if((F.col("crop_id") % 7 != 0) & (F.col("crop_id") % 5 == 0)).alias("added"), F.count_if((F.col("crop_id") % 5 != 0) & (F.col("crop_id") % 7 == 0)).alias("removed"))
    means = tracks.to_group(tracks.prototypes(dg.track_stats(spark, sf)), dg.folders(spark, sf), "folder").groupBy("folder").agg(F.avg("reid_sim").alias("track_reid_mean"), F.avg("color_sim").alias("track_color_mean"))
    out = dg.folder_summary(spark, sf).drop("status", "overlap_pair_count").join(own, "folder").join(means, "folder")
    return dg.r6(out, "track_reid_mean", "track_color_mean")


def refined_files(spark: SparkSession, sf: str) -> DataFrame:
    """Where each crop goes: its person's folder, and a name that no other file there has."""
    c = fx.crops(spark, sf).select(F.col("folder").alias("person_id"), F.format_string("crop_%08d", "crop_id").alias("src"), F.format_string("frame_%06d_l%d.jpg", F.col("frame") % 10, F.col("local_id") % 2).alias("name"))
    return destination(c).select("src", names.person_folder(F.col("person_id")).alias("dest_folder"), "dest_name")


def crop_metadata_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Confidences by file name, else by frame and track; some entries hold the value under another name, some hold no number."""
    c = fx.crops(spark, sf).select("crop_id", F.format_string("crop_%d.jpg", "crop_id").alias("name"), "frame", "local_id")
    k = F.col("crop_id")
    entries = c.select(
        F.when(k % 2 == 0, F.col("name")).alias("file"), F.when(k % 3 != 0, F.col("frame")).alias("frame"), F.col("frame").alias("frame_number"), F.col("local_id").alias("track_id"),
        F.when(k % 5 == 0, F.lit("bad")).when(k % 5 == 1, (k / 1000).cast("string")).alias("confidence"), F.when(k % 5 > 2, (k / 500).cast("string")).alias("score"),
    ).where(k % 7 != 0)
    return dg.r6(names.crop_metadata(c, entries).select("crop_id", "conf"), "conf")


def ema_update(spark: SparkSession, sf: str) -> DataFrame:
    """One step of a moving prototype: each crop's track predecessor is blended with it."""
    w = Window.partitionBy("folder", "local_id").orderBy("crop_id")
    c = fx.crops(spark, sf).withColumns({"old_emb": F.lag("emb").over(w), "old_up": F.lag("up").over(w)}).where("old_emb is not null")
    out = c.withColumns({"proto": ema_unit("old_emb", "emb", ALPHA), "hist": ema_hist("old_up", "up", HIST_ALPHA)})
    return dg.r6(out.select("crop_id", dot("proto", "emb").alias("sim_new"), dot("proto", "old_emb").alias("sim_old"), dot("hist", "hist").alias("hist_sq"), total("hist").alias("hist_sum")), "sim_new", "sim_old", "hist_sq", "hist_sum")


def ragged_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of folders that exist, and error rows of fewer columns for those that do not."""
    good = dg.folder_summary(spark, sf).select("folder", "image_count", "track_count", "status")
    asked = spark.range(0, 13).select(F.col("id").cast("int").alias("folder"))
    bad = asked.join(good.select("folder"), "folder", "left_anti").withColumn("status", F.lit("missing"))
    return good.unionByName(bad, allowMissingColumns=True)


def frame_window(spark: SparkSession, sf: str) -> DataFrame:
    """Detections up to a frame cap, and the one frame that a seek asks for (counted from 0, frames are from 1)."""
    d = fx.detections(spark, sf)
    return d.where("frame_idx <= 144").select("det_id", "frame_idx", (F.col("frame_idx") - 1 == 12).alias("sought"))


QUERIES = {f.__name__: f for f in (detection_filter, funnel_counts, track_census, best_other_track, folder_manifests, refined_files, crop_metadata_lookup, ema_update, ragged_report, frame_window)}

CLASSED = f"{DETECTIONS}, e as (select * exclude (local_id), case when det_id % 3 = 2 then 1 else 0 end as cls, (det_id * 41 % 1000) / 1000.0::DOUBLE as conf, case when det_id % 11 <> 0 then local_id end as local_id from d)"
KEPT = f"coalesce(cls = 0 and conf >= {LEAST_CONF} and local_id is not null and x2 > x1 and y2 > y1, false)"
SAVED = "(bw >= 10 and bh >= 20 and area_ratio >= 0.0010::DOUBLE and sharpness >= 8)"
LINKABLE = "(bw >= 10 and bh >= 20 and area_ratio >= 0.0012::DOUBLE and sharpness >= 12)"
EMA = "list_transform(list_zip({0}, {1}), lambda z: {2} * z[1] + {3} * z[2])"

SQL = {
    "detection_filter": f"with {CLASSED} select det_id, video_id, frame_idx, local_id, x1, y1, x2, y2 from e where {KEPT}",
    "funnel_counts": f"""with {CLASSED} select video_id, count(*) as seen, count(*) filter ({KEPT}) as detected, count(*) filter ({KEPT} and {SAVED}) as saved, count(*) filter ({KEPT} and not {SAVED}) as filtered,
count(*) filter ({KEPT} and {LINKABLE}) as linkable, count(distinct local_id) as tracks from e group by video_id""",
    "track_census": f"with {DETECTIONS} select video_id, local_id, count(*) as n, count(distinct frame_idx) as frames, min(frame_idx) as first_frame, max(frame_idx) as last_frame from d group by video_id, local_id having count(*) >= {LEAST_TRACK}",
    "best_other_track": f"""with {CROPS}, {TRACKS}, m as (select a.folder, a.local_id, b.local_id as other, {sims()} from tracks a join tracks b on a.folder = b.folder and a.local_id <> b.local_id),
r as (select *, reid_sim + color_sim as s, row_number() over (partition by folder, local_id order by round(reid_sim + color_sim, 9) desc, other) as k from m)
select folder, local_id, other, round(reid_sim, 6) as reid_sim, round(color_sim, 6) as color_sim, frame_overlap, round(s, 6) as score from r where k = 1""",
    "folder_manifests": f"""with {CROPS}, {TRACKS}, {FOLDERS}, f as (select *, printf('crop_%08d.jpg', crop_id) as file from crops),
s as (select folder, avg(x) as a, min(x) as b, max(x) as c from (select folder, list_dot_product(emb, proto) as x from crops join folders using (folder)) group by folder),
o as (select folder, min(file) as first_file, max(file) as last_file, count(*) filter (crop_id % 7 <> 0 and crop_id % 5 = 0) as added, count(*) filter (crop_id % 5 <> 0 and crop_id % 7 = 0) as removed from f group by folder),
t as (select folder, count(*) as track_count, avg(reid_sim) as tr, avg(color_sim) as tc from (select a.folder, {sims()} from tracks a join folders b using (folder)) group by folder)
select folder, n as image_count, track_count, frame_min, frame_max, round(a, 6) as folder_sim_mean, round(b, 6) as folder_sim_min, round(c, 6) as folder_sim_max, first_file, last_file, added, removed,
round(tr, 6) as track_reid_mean, round(tc, 6) as track_color_mean from folders join s using (folder) join o using (folder) join t using (folder)""",
    "refined_files": f"""with {CROPS}, n as (select folder, printf('crop_%08d', crop_id) as src, printf('frame_%06d_l%d', frame % 10, local_id % 2) as stem from crops),
r as (select *, row_number() over (partition by folder, stem order by src) - 1 as k from n)
select src, printf('person_%03d', folder) as dest_folder, stem || case when k = 0 then '' else '_' || k end || '.jpg' as dest_name from r""",
    "crop_metadata_lookup": f"""with {CROPS}, n as (select crop_id, 'crop_' || crop_id || '.jpg' as name, frame, local_id from crops),
e as (select case when crop_id % 2 = 0 then name end as file, frame, local_id, case crop_id % 5 when 1 then crop_id / 1000.0::DOUBLE when 3 then crop_id / 500.0::DOUBLE when 4 then crop_id / 500.0::DOUBLE end as c from n where crop_id % 7 <> 0),
f as (select file, max(c) as fc from e where file is not null group by file), k as (select frame, local_id, max(c) as kc from e group by frame, local_id)
select crop_id, round(coalesce(fc, kc), 6) as conf from n left join f on name = file left join k using (frame, local_id)""",
    "ema_update": f"""with {CROPS}, p as (select crop_id, emb, up, lag(emb) over w as oe, lag(up) over w as ou from crops window w as (partition by folder, local_id order by crop_id)),
b as (select *, {EMA.format("oe", "emb", 1 - ALPHA, ALPHA)} as v, {EMA.format("ou", "up", 1 - HIST_ALPHA, HIST_ALPHA)} as h from p where oe is not null),
c as (select *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as proto, list_transform(h, lambda x: x / list_sum(h)) as hist from b)
select crop_id, round(list_dot_product(proto, emb), 6) as sim_new, round(list_dot_product(proto, oe), 6) as sim_old, round(list_dot_product(hist, hist), 6) as hist_sq, round(list_sum(hist), 6) as hist_sum from c""",
    "ragged_report": f"""with {CROPS}, g as (select folder, count(*) as image_count, count(distinct local_id) as track_count from crops group by folder)
select *, 'ok' as status from g union all select cast(i as int), null, null, 'missing' from range(0, 13) r(i) where i not in (select folder from g)""",
    "frame_window": f"with {DETECTIONS} select det_id, frame_idx, frame_idx - 1 = 12 as sought from d where frame_idx <= 144",
}
