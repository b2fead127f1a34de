"""Quality gates as boolean columns, and reports over them. Cheap geometry stands before sharpness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.config import Thresholds


def aspect(w: Column, h: Column) -> Column:
    """The longer side over the shorter, both ways; sides count as 1 at least."""
    one = F.lit(1)
    return F.greatest(h / F.greatest(one, w), w / F.greatest(one, h))


def size_gate(gate: tuple) -> dict[str, Column]:
    w, h, area, sharp = gate
    return {"width": F.col("bw") >= w, "height": F.col("bh") >= h, "area": F.col("area_ratio") >= area, "sharpness": F.col("sharpness") >= sharp}


def all_of(tests: dict[str, Column]) -> Column:
    out = F.lit(True)
    for t in tests.values():
        out = out & t
    return out


def save_ok(t: Thresholds = Thresholds()) -> Column:  # noqa: B008
    return all_of(size_gate(t.save_gate))


def reid_ok(t: Thresholds = Thresholds()) -> Column:  # noqa: B008
    return all_of(size_gate(t.reid_gate))


def stage_a_ok(t: Thresholds = Thresholds(), area_check: bool = False) -> Column:  # noqa: B008
    """Offline gate: sizes, area if asked for, sharpness, and aspect unless its limit is 0."""
    w, h, _, _ = t.reid_gate
    tests = {"w": F.col("bw") >= w, "h": F.col("bh") >= h}
    if area_check:
        tests["area"] = F.col("area_ratio") >= t.refine_area
    tests["sharp"] = F.col("sharpness") >= t.refine_sharpness
    if t.refine_aspect > 0:
        tests["aspect"] = aspect(F.col("bw"), F.col("bh")) <= t.refine_aspect
    return all_of(tests)


def track_gate_ok(t: Thresholds = Thresholds()) -> Column:  # noqa: B008
    """The gate without sizes: area, sharpness, aspect."""
    return (F.col("area_ratio") >= t.refine_area) & (F.col("sharpness") >= t.refine_sharpness) & (aspect(F.col("bw"), F.col("bh")) <= t.refine_aspect)


def detection_ok(t: Thresholds = Thresholds()) -> Column:  # noqa: B008
    """Persons of enough confidence with a track id and a box that has an area."""
    return (F.col("cls") == 0) & (F.col("conf") >= t.detection_confidence) & F.col("local_id").isNotNull() & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))


def matrix(t: Thresholds = Thresholds()) -> dict[str, Column]:  # noqa: B008
    """Eleven gates by name, in a fixed order."""
    out = {f"save_{k}": c for k, c in size_gate(t.save_gate).items()} | {f"reid_{k}": c for k, c in size_gate(t.reid_gate).items()}
    return out | {"refine_area": F.col("area_ratio") >= t.refine_area, "refine_sharpness": F.col("sharpness") >= t.refine_sharpness, "refine_aspect": aspect(F.col("bw"), F.col("bh")) <= t.refine_aspect}


def with_matrix(d: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    return d.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in matrix(t).items()})


def pass_counts(d: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """(gate, passed, failed) for each gate and for all together: one aggregation, then a row for each."""
    gates = [*matrix(t), "all"]
    m = with_matrix(d, t).withColumn("all", F.array_min(F.array(*[F.col(g) for g in gates[:-1]])))
    sums = m.agg(*[F.count_if(g).alias(g) for g in gates], F.count("*").alias("tw_n"))
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed"), (F.col("tw_n") - F.col(g)).alias("failed")) for g in gates])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def failed_gates(d: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Adds failed (names joined by ', ') and class: all, none or some passed."""
    gates = list(matrix(t))
    m = with_matrix(d, t).withColumn("failed", F.concat_ws(", ", *[F.when(~F.col(g), g) for g in gates]))
    values = F.array(*[F.col(g) for g in gates])
    return m.withColumn("class", F.when(F.forall(values, lambda x: x), "all").when(F.exists(values, lambda x: x), "some").otherwise("none"))


def histogram(d: DataFrame, metric: str, bins: int = 30) -> DataFrame:
    """(bin, n) over equal bins between least and greatest; the last bin is closed; empty bins give no row."""
    ends = d.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    m = d.where(F.col(metric).isNotNull()).crossJoin(F.broadcast(ends))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(metric) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(F.lit(bins // 2))
    return m.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def examples(d: DataFrame, order: str, fails: int = 2, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """The first failing rows of each gate, by order: (gate, order)."""
    from pyspark.sql import Window

    gates = list(matrix(t))
    m = with_matrix(d, t).select(order, F.explode(F.filter(F.array(*[F.when(~F.col(g), g) for g in gates]), lambda x: x.isNotNull())).alias("gate"))
    return m.withColumn("k", F.row_number().over(Window.partitionBy("gate").orderBy(order))).where(f"k <= {int(fails)}").select("gate", order)
