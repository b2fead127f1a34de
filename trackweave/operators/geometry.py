"""Boxes, colours, labels: the data half of drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.vectors import iou


def safe_crop(d: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes clipped to the image (cx1..cy2); all null where nothing is left."""
    c = {"cx1": F.greatest(F.lit(0), F.least("x1", F.lit(width - 1))), "cy1": F.greatest(F.lit(0), F.least("y1", F.lit(height - 1))), "cx2": F.greatest(F.lit(0), F.least("x2", F.lit(width))), "cy2": F.greatest(F.lit(0), F.least("y2", F.lit(height)))}
    out = d.withColumns(c)
    left = (F.col("cx2") > F.col("cx1")) & (F.col("cy2") > F.col("cy1"))
    return out.select(*d.columns, *[F.when(left, F.col(k)).alias(k) for k in c])


def same_frame_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Boxes of two detectors in one frame with an overlap of at least `least`: (frame_idx, a_id, b_id, iou)."""
    mark = lambda d, p: d.select("frame_idx", F.col("det_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")])
    met = mark(a, "a").join(mark(b, "b"), "frame_idx").where("a_x1 < b_x2 and b_x1 < a_x2 and a_y1 < b_y2 and b_y1 < a_y2")
    return met.withColumn("iou", iou("a", "b")).where(F.col("iou") >= least).select("frame_idx", "a_id", "b_id", "iou")


def hue(pid: Column) -> Column:
    """0..178: the golden ratio spreads neighbouring ids."""
    return F.floor(F.pmod(pid * F.lit(0.61803398875), F.lit(1.0)) * 179).cast("int")


def bgr(h: Column, s: int = 200, v: int = 255) -> Column:
    """struct b, g, r of a hue in 0..179 at a saturation and value in 0..255."""
    sector, part = F.floor(h / 30).cast("int"), h / 30 - F.floor(h / 30)
    sat = s / 255
    p, q, t = F.lit(v * (1 - sat)), v * (1 - sat * part), v * (1 - sat * (1 - part))
    pick = lambda *xs: F.round(F.get(F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs]), sector % 6)).cast("int")
    return F.struct(pick(p, p, t, v, v, q).alias("b"), pick(t, v, v, q, p, p).alias("g"), pick(v, q, p, p, t, v).alias("r"))


def identity_map(crops: DataFrame) -> DataFrame:
    """(frame, local_id) -> person; the last folder by name wins."""
    return crops.groupBy("frame", "local_id").agg(F.max("folder").alias("person_id"))


def overlay(d: DataFrame, identities: DataFrame) -> DataFrame:
    """Every detection with its person, label, anchor and hue; an unknown one is '?'."""
    m = identities.select(F.col("frame").alias("frame_idx"), "local_id", "person_id")
    out = d.join(m, ["frame_idx", "local_id"], "left")
    known = F.col("person_id").isNotNull()
    return out.withColumns({
        "label": F.when(known, F.format_string("P%d", "person_id")).otherwise("?"),
        "review_label": F.when(known, F.format_string("P%03d L%d", "person_id", "local_id")).otherwise(F.format_string("L%d ?", "local_id")),
        "text_y": F.greatest(F.col("y1") - 10, F.lit(20)), "review_y": F.when(F.col("y1") > 24, F.col("y1") - 10).otherwise(F.col("y1") + 20), "hue": hue(F.col("person_id")),
    })


def online_labels(d: DataFrame, gid: str = "gid") -> DataFrame:
    """What is drawn while linking: L:<local> above the box (below its upper edge near the image's), G:<global> or G:? beneath it, in the identity's colour."""
    known, y = F.col(gid).isNotNull(), F.when(F.col("y1") > 24, F.col("y1") - 10).otherwise(F.col("y1") + 20)
    tint = bgr(hue(F.col(gid)), 220)
    #: The colour of an unknown identity.
    plain = {"b": 0, "g": 165, "r": 255}
    return d.withColumns({"local_text": F.format_string("L:%d", "local_id"), "global_text": F.when(known, F.format_string("G:%d", gid)).otherwise("G:?"), "local_y": y, "global_y": y + 18} | {c: F.when(known, tint[c]).otherwise(F.lit(v)) for c, v in plain.items()})
