"""Detections and crops derived from the driver's tables, so that every relational operator has an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.vectors import total

HALF, SIZE, WIDTH, HEIGHT, CAMERAS = 32, 64, 1280, 720, 8


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crop_id, folder, local_id, frame, emb, up, lo."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("emb"))
    half = lambda at: F.transform(F.slice("emb", at, HALF), F.abs)
    e = e.withColumns({"up_raw": half(1), "lo_raw": half(HALF + 1)}).withColumns({"up_sum": total("up_raw"), "lo_sum": total("lo_raw")})
    return e.select(
        F.col("vec_id").alias("crop_id"), F.col("label").alias("folder"), (F.col("vec_id") % 5).cast("int").alias("local_id"), F.floor(F.col("vec_id") / 5).cast("long").alias("frame"), "emb",
        F.transform("up_raw", lambda x: x / F.col("up_sum")).alias("up"), F.transform("lo_raw", lambda x: x / F.col("lo_sum")).alias("lo"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections: video_id, det_id, frame_idx (ten minutes each), local_id, sharpness, bw, bh, area_ratio, x1, y1, x2, y2.

    Frames follow from the parts of the zone-less time, so that the session's time zone has no say.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tens = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) * 144 + F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)
    k = F.get_json_object("props", "$.k").cast("int")
    d = e.select(
        (F.col("user_id") % CAMERAS).alias("video_id"), F.col("event_id").alias("det_id"), (tens - 2840112 + 1).cast("long").alias("frame_idx"), F.col("user_id").cast("int").alias("local_id"), F.col("value").alias("sharpness"), k.alias("bw"), (2 * k).alias("bh"),
        ((F.col("event_id") * 37) % 1180).cast("int").alias("x1"), ((F.col("event_id") * 53) % 520).cast("int").alias("y1"),
    )
    return d.withColumns({"area_ratio": F.col("bw") * F.col("bh") / F.lit(float(WIDTH * HEIGHT)), "x2": F.col("x1") + F.col("bw"), "y2": F.col("y1") + F.col("bh")})


def keyed(d: DataFrame) -> DataFrame:
    """One detection for each (frame_idx, local_id): the least det_id."""
    least = F.min(F.struct("det_id", *[c for c in d.columns if c not in ("det_id", "frame_idx", "local_id")]))
    return d.groupBy("frame_idx", "local_id").agg(least.alias("d")).select("frame_idx", "local_id", "d.*")


def features(spark: SparkSession, sf_dir: str, person: bool = False) -> DataFrame:
    """Keyed detections with a crop's vectors (by det_id) and the quality flag: input of online linking. person: and the crop's folder, as person_id."""
    own = crops(spark, sf_dir).select(F.col("crop_id"), F.col("emb").alias("embedding"), F.col("up").alias("upper"), F.col("lo").alias("lower"), F.col("folder").alias("person_id"))
    n = own.select(F.count("*").alias("n_crops"))
    d = keyed(detections(spark, sf_dir)).crossJoin(F.broadcast(n)).withColumn("crop_key", F.col("det_id") % F.greatest("n_crops", F.lit(1)))
    ok = (F.col("bw") >= 10) & (F.col("bh") >= 20) & (F.col("area_ratio") >= 0.0012) & (F.col("sharpness") >= 12)
    return d.join(own, F.col("crop_key") == F.col("crop_id")).select(
        F.col("video_id").cast("long"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("det_id").alias("det_seq"), "local_id", F.struct(*[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"),
        F.lit(1.0).alias("conf"), F.coalesce(ok, F.lit(False)).alias("reid_ok"), "embedding", "upper", "lower", *(["person_id"] if person else []),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pictures of 8 x 8 pixels: crop_id, height, width, pixels (blue, green, red bytes made of a vector's numbers)."""
    v = crops(spark, sf_dir).select("crop_id", F.transform("emb", lambda x: (F.floor(F.abs(x) * 1024) % 256).cast("int")).alias("v"))
    triples = F.flatten(F.transform("v", lambda x, i: F.array(x, F.get("v", (i + 21) % 64), F.get("v", (i + 42) % 64))))
    return v.select("crop_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(F.transform(triples, lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("pixels"))


SPECS = ["4 is 3", "2, 1 is 0", "5 : 6", "7 = 8", "9 bad"]
LABELLED = ["4 is 3", "20 is 7", "34, 21 is 16", "31, 23 is 19", "33, 28, 27 is 2", "30 is 17", "32 is 1", "33 bad"]

