"""Vector and box arithmetic as column expressions; all sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2(v: Column | str) -> Column:
    """Unit vector; a vector shorter than 1e-12 stays."""
    length = norm(v)
    return F.when(length > 1e-12, F.transform(_col(v), lambda x: x / length)).otherwise(_col(v))


def to_sum_one(v: Column | str) -> Column:
    whole = total(v)
    return F.when(whole > 1e-12, F.transform(_col(v), lambda x: x / whole)).otherwise(_col(v))


def hist_intersect(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.least(x.cast("double"), y.cast("double"))))


def color_similarity(up1: Column | str, lo1: Column | str, up2: Column | str, lo2: Column | str) -> Column:
    return 0.4 * hist_intersect(up1, up2) + 0.6 * hist_intersect(lo1, lo2)


def blend(old: Column | str, new: Column | str, alpha: float) -> Column:
    return F.zip_with(_col(old), _col(new), lambda x, y: (1 - alpha) * x + alpha * y)


def ema_unit(old: Column | str, new: Column | str, alpha: float) -> Column:
    return l2(blend(old, new, alpha))


def ema_hist(old: Column | str, new: Column | str, alpha: float) -> Column:
    return to_sum_one(blend(old, new, alpha))


def iou(a: str, b: str, sep: str = "_") -> Column:
    """Of boxes in columns a_x1, a_y1, a_x2, a_y2 and b_...; 0 where the union is empty."""
    c = lambda p, n: F.col(f"{p}{sep}{n}").cast("double")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda p: F.greatest(F.lit(0.0), c(p, "x2") - c(p, "x1")) * F.greatest(F.lit(0.0), c(p, "y2") - c(p, "y1"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def overlap(a: Column | str, b: Column | str) -> Column:
    """How many frames two sets share; -1 (unparsed) counts as a frame."""
    return F.size(F.array_intersect(_col(a), _col(b)))


def element_sums(column: str, size: int, alias: str) -> list[Column]:
    """Aggregates that add a vector column up element by element: partial sums on the map side, no row for each element."""
    return [F.sum(F.get(F.col(column), F.lit(i))).alias(f"{alias}_{i}") for i in range(size)]


def gathered(alias: str, size: int) -> Column:
    return F.array(*[F.col(f"{alias}_{i}") for i in range(size)])
