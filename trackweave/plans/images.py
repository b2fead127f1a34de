"""Queries on pixels and whole manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import pixels
from trackweave.functions.vectors import dot, hist_intersect, total
from trackweave.operators import geometry, manifest, tracks
from trackweave.plans import diagnostics as dg
from trackweave.plans.sql import CROPS, DETECTIONS, FOLDERS, TRACKS, sims
from trackweave.sources import fixtures as fx

PICTURE = ("height", "width", "pixels")


def crop_sharpness(spark: SparkSession, sf: str) -> DataFrame:
    return fx.images(spark, sf).select("crop_id", F.round(pixels.sharpness(*map(F.col, PICTURE)), 6).alias("sharpness"))


def crop_signature(spark: SparkSession, sf: str) -> DataFrame:
    """Colour signatures of pictures as they are: filled cells, sums of squares, places of cells, and what both halves share."""
    s = fx.images(spark, sf).select("crop_id", pixels.color_signature(*map(F.col, PICTURE), size=None).alias("s")).select("crop_id", F.get("s", F.lit(0)).alias("up"), F.get("s", F.lit(1)).alias("lo"))
    cells = lambda c: F.size(F.filter(c, lambda x: x > 0)).cast("long")
    place = lambda c: total(F.transform(c, lambda x, i: x * i))
    return dg.r6(s.select("crop_id", cells("up").alias("up_cells"), cells("lo").alias("lo_cells"), dot("up", "up").alias("up_sq"), dot("lo", "lo").alias("lo_sq"), place("up").alias("up_place"), place("lo").alias("lo_place"), hist_intersect("up", "lo").alias("shared")), "up_sq", "lo_sq", "up_place", "lo_place", "shared")


def network_input(spark: SparkSession, sf: str) -> DataFrame:
    """What a network would get, turned back into bytes: sums over places of each channel."""
    d = fx.images(spark, sf).select("crop_id", pixels.network_input(*map(F.col, PICTURE), size=None).alias("x"))

    def told(k: int) -> Column:
        byte = F.transform(F.slice("x", 64 * k + 1, 64), lambda v, i: F.round((v * pixels.DEVIATION[k].item() + pixels.MEAN[k].item()) * 255).cast("long") * (i + 1))
        return F.aggregate(byte, F.lit(0).cast("long"), lambda s, v: s + v)

    return d.select("crop_id", *[told(k).alias(c) for k, c in enumerate(("red", "green", "blue"))])


def id_color(spark: SparkSession, sf: str) -> DataFrame:
    """The colour that an id is drawn in."""
    ids = dg.detections(spark, sf).select("local_id").distinct()
    return ids.withColumn("c", geometry.bgr(geometry.hue(F.col("local_id")))).select("local_id", "c.b", "c.g", "c.r")


def folder_databases(spark: SparkSession, sf: str) -> DataFrame:
    """Whole manifests, their lists joined: crops of every fifth id are new, those of every seventh are gone."""
    c = fx.crops(spark, sf).withColumn("file", F.format_string("crop_%08d.jpg", "crop_id"))
    old = c.where("crop_id % 5 <> 0").groupBy("folder").agg(F.sort_array(F.collect_list("file")).alias("files")).where("folder <> 3")
    gone = c.select("folder", F.concat(F.lit("old_"), "file").alias("file")).where(F.col("file").endswith("7.jpg")).groupBy("folder").agg(F.sort_array(F.collect_list("file")).alias("more"))
    old = old.join(gone, "folder", "left").select("folder", F.concat("files", F.coalesce("more", F.array().cast("array<string>"))).alias("files"))
    m = manifest.databases(c, tracks.prototypes(dg.track_stats(spark, sf)), dg.folders(spark, sf), old)
    line = lambda k, v: F.format_string("%s:%d:%d:%d:%.4f:%.4f:%s", k, v["image_count"], v["frame_min"], v["frame_max"], v["mean_similarity_to_track_proto"], v["prototype_similarity_to_folder"], F.element_at(v["files"], 1))
    return m.select(
        "folder", "image_count", F.array_join("files", ",").alias("files"), F.array_join("added_files", ",").alias("added"), F.array_join("removed_files", ",").alias("removed"),
        F.round("folder_summary.folder_proto_mean_similarity", 6).alias("folder_mean"), F.array_join(F.transform(F.map_entries("tracks"), lambda e: line(e["key"], e["value"])), ";").alias("tracks"),
        F.array_join(F.transform("images", lambda i: F.concat_ws(":", i["file"], i["frame"].cast("string"), i["local_id"].cast("string"))), ",").alias("images"),
    )


QUERIES = {f.__name__: f for f in (crop_sharpness, crop_signature, network_input, id_color, folder_databases)}

BYTES = "v as (select vec_id as crop_id, list_transform(embedding::DOUBLE[], lambda x: cast(floor(abs(x) * 1024) as int) % 256) as v from embeddings)"
PIXELS = f"{BYTES}, p as (select crop_id, i, v[i + 1] as b, v[(i + 21) % 64 + 1] as g, v[(i + 42) % 64 + 1] as r from v, range(0, 64) t(i))"
LINEAR = "case when {0} / 255.0::DOUBLE > 0.04045 then (({0} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 else {0} / 255.0::DOUBLE / 12.92 end"
ROOT = "case when {0} > 0.008856 then cbrt({0}) else 7.787::DOUBLE * {0} + 16.0::DOUBLE / 116 end"
BYTE = "cast(least(greatest(floor({0} + 0.5), 0), 255) as int) // 32"

SQL = {
    "crop_sharpness": f"""with {BYTES}, g as (select crop_id, list_transform(range(0, 64), lambda i: (114 * v[i + 1] + 587 * v[(i + 21) % 64 + 1] + 299 * v[(i + 42) % 64 + 1] + 500) // 1000) as g from v),
l as (select crop_id, list_transform(range(0, 64), lambda i: g[abs(i // 8 - 1) * 8 + i % 8 + 1] + g[(7 - abs(6 - i // 8)) * 8 + i % 8 + 1] + g[i // 8 * 8 + abs(i % 8 - 1) + 1] + g[i // 8 * 8 + 8 - abs(6 - i % 8)] - 4 * g[i + 1]) as l from g)
select crop_id, round(list_aggregate(l, 'var_pop'), 6) as sharpness from l""",
    "crop_signature": f"""with {PIXELS}, n as (select crop_id, i < 32 as up, {LINEAR.format("r")} as r, {LINEAR.format("g")} as g, {LINEAR.format("b")} as b from p),
x as (select crop_id, up, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.950456::DOUBLE as x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b as y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.088754::DOUBLE as z from n),
f as (select crop_id, up, y, {ROOT.format("x")} as fx, {ROOT.format("y")} as fy, {ROOT.format("z")} as fz from x),
c as (select crop_id, up, ({BYTE.format("(case when y > 0.008856 then 116 * fy - 16 else 903.3::DOUBLE * y end) * 255 / 100")}) * 64 + ({BYTE.format("500 * (fx - fy) + 128")}) * 8 + {BYTE.format("200 * (fy - fz) + 128")} as cell from f),
k as (select crop_id, cell, count(*) filter (up) / 32.0::DOUBLE as u, count(*) filter (not up) / 32.0::DOUBLE as l from c group by crop_id, cell)
select crop_id, count(*) filter (u > 0) as up_cells, count(*) filter (l > 0) as lo_cells, round(sum(u * u), 6) as up_sq, round(sum(l * l), 6) as lo_sq, round(sum(u * cell), 6) as up_place, round(sum(l * cell), 6) as lo_place, round(sum(least(u, l)), 6) as shared from k group by crop_id""",
    "network_input": f"with {PIXELS} select crop_id, cast(sum((i + 1) * r) as bigint) as red, cast(sum((i + 1) * g) as bigint) as green, cast(sum((i + 1) * b) as bigint) as blue from p group by crop_id",
    "id_color": f"""with {DETECTIONS}, h as (select distinct local_id, cast(floor(((local_id * 0.61803398875::DOUBLE) % 1.0) * 179) as int) as h from d),
s as (select local_id, h // 30 as k, 255 - 200 as p, 255 - 200 * (h % 30) / 30.0::DOUBLE as q, 255 - 200 * (30 - h % 30) / 30.0::DOUBLE as t from h)
select local_id, cast(round(case k when 0 then p when 1 then p when 2 then t when 3 then 255 when 4 then 255 else q end) as int) as b,
cast(round(case k when 0 then t when 1 then 255 when 2 then 255 when 3 then q else p end) as int) as g, cast(round(case k when 0 then 255 when 1 then q when 2 then p when 3 then p when 4 then t else 255 end) as int) as r from s""",
    "folder_databases": f"""with {CROPS}, {TRACKS}, {FOLDERS}, f as (select *, printf('crop_%08d.jpg', crop_id) as file from crops),
i as (select folder, count(*) as image_count, string_agg(file, ',' order by file) as files, string_agg(case when crop_id % 5 = 0 or folder = 3 then file end, ',' order by file) as added,
string_agg(case when folder <> 3 and file like '%7.jpg' then 'old_' || file end, ',' order by file) as removed, string_agg(file || ':' || frame || ':' || local_id, ',' order by file) as images from f group by folder),
s as (select folder, avg(list_dot_product(emb, proto)) as a from crops join folders using (folder) group by folder),
o as (select folder, local_id, avg(list_dot_product(emb, proto)) as a, min(file) as first from f join tracks using (folder, local_id) group by folder, local_id),
n as (select a.folder, a.local_id, a.n, a.frame_min, a.frame_max, {sims()} from tracks a join folders b using (folder)),
t as (select folder, string_agg(printf('%d:%d:%d:%d:%.4f:%.4f:%s', local_id, n, frame_min, frame_max, a, reid_sim, first), ';' order by local_id) as tracks from n join o using (folder, local_id) group by folder)
select folder, image_count, files, coalesce(added, '') as added, coalesce(removed, '') as removed, round(a, 6) as folder_mean, tracks, images from i join s using (folder) join t using (folder)""",
}
