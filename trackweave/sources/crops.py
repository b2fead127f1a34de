"""Crop folders and files as tables: names parsed and made, folders scanned, manifests read, pair specs parsed, files sampled evenly."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave import schema

# fixed values: endings of image files; names of folders (person_, track_) and of crops (frame_, _t, _l) below
IMAGES = ["jpg", "jpeg", "png", "bmp", "webp"]


def parsed_int(text: Column, pattern: str, group: int = 1) -> Column:
    """The number that a pattern finds, -1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int"), F.lit(-1))


def with_names(files: DataFrame, column: str = "name") -> DataFrame:
    """Adds frame and local_id (-1 both if the name lacks either) and frame_only (-1 on a miss)."""
    stem = F.regexp_replace(F.col(column), r"\.[^.]*$", "")
    both = r"frame_(\d+).*_l(\d+)"
    return files.withColumns({"frame": parsed_int(stem, both, 1), "local_id": parsed_int(stem, both, 2), "frame_only": parsed_int(stem, r"frame_(\d+)")})


def crop_name(frame: Column, seconds: Column, local_id: Column) -> Column:
    return F.format_string("frame_%06d_t%.3f_l%d.jpg", frame, seconds, local_id)


def person_folder(pid: Column) -> Column:
    return F.format_string("person_%03d", pid)


def folder_token(token: Column) -> Column:
    """A folder from a token: digits become person_%03d (longer ids whole), all else stays."""
    number = token.try_cast("long")
    return F.when(token.rlike("^[0-9]+$"), F.format_string("person_%03d", F.coalesce(number, F.lit(0)))).otherwise(token)


def resolved_path(path: str | None, default: str, bases: list[str], exists: Callable[[Path], bool] = Path.exists) -> Path:
    """An absolute path stays; else the first of bases below which it exists, else below the first base. A driver's helper for a command's few arguments."""
    asked = Path(path or default)
    tries = [asked] if asked.is_absolute() else [Path(b) / asked for b in bases]
    return next((t for t in tries if exists(t)), tries[0])


def resolved_folder(root: str, token: str, exists: Callable[[Path], bool] = Path.exists) -> Path:
    """A folder from a spec's token: one that is absolute or exists stays; digits become person_%03d below root, all else goes below root. An empty token raises."""
    token = token.strip()
    if not token:
        raise ValueError("an empty folder token")
    asked = Path(token)
    if asked.is_absolute() or exists(asked):
        return asked
    return Path(root) / (f"person_{int(token):03d}" if token.isdigit() else token)


def pair_specs(specs: DataFrame, column: str = "spec") -> DataFrame:
    """A row (spec, left, right, status) for each pair; a spec that does not parse gives one row with status 'error'."""
    pattern = r"^\s*(.*?)\s*(?:(?i:\bis\b)|:|=)\s*(.*?)\s*$"
    left, right = (F.regexp_extract(column, pattern, n) for n in (1, 2))
    lefts = F.filter(F.transform(F.split(left, ","), lambda x: F.trim(x)), lambda x: x != "")
    good = F.col(column).rlike(pattern) & (right != "") & ~right.contains(",") & (F.size(lefts) > 0)
    out = specs.withColumn("left", F.explode(F.when(good, lefts).otherwise(F.array(F.lit(None).cast("string")))))
    return out.select(column, "left", F.when(good, right).alias("right"), F.when(good, F.lit("ok")).otherwise(F.lit("error")).alias("status"))


def even_sample(files: DataFrame, k: int, group: list[str], order: list[str]) -> DataFrame:
    """At most k files of each group, evenly spaced by order, first and last included; k = 0 keeps all."""
    if not k:
        return files
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    ranked = files.withColumns({"tw_place": place, "tw_n": F.count("*").over(Window.partitionBy(*group))})
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("tw_n") - 1) / F.lit(max(1, k - 1))))
    return ranked.where((F.col("tw_n") <= k) | F.array_contains(spots, F.col("tw_place").cast("long"))).drop("tw_place", "tw_n")


def scan_folders(spark: SparkSession, root: str, prefix: str = "person_", content: bool = False) -> DataFrame:
    """Image files below root/prefix*: path, folder, name, frame, local_id, mtime, and content if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.withColumns({"folder": F.element_at(F.split("path", "/"), -2), "name": F.element_at(F.split("path", "/"), -1)})
    files = files.where(F.col("folder").startswith(prefix) & F.lower(F.element_at(F.split("name", r"\."), -1)).isin(IMAGES))
    return with_names(files).select("path", "folder", "name", "frame", "local_id", F.col("modificationTime").alias("mtime"), *(["content"] if content else []))


def track_folder(local_id: Column) -> Column:
    return F.format_string("track_%03d", local_id)


def track_folder_order(folder: Column) -> Column:
    """track_ folders sort by their number."""
    return parsed_int(folder, r"_(\d+)$")


def person_id(folder: Column) -> Column:
    return F.nullif(F.regexp_extract(folder, r"^person_(\d+)$", 1), F.lit("")).try_cast("int")


def read_manifest(texts: DataFrame, column: str = "value") -> DataFrame:
    """Folder manifests; one that does not parse is as if absent: all fields null."""
    return texts.withColumn("manifest", F.from_json(column, schema.MANIFEST, {"mode": "PERMISSIVE"}))


def crop_metadata(crops: DataFrame, entries: DataFrame) -> DataFrame:
    """Crops with external metadata: the entry of the same file name first, else of the same (frame, local_id)."""
    number = lambda *names: F.coalesce(*[F.col(n).try_cast("double") for n in names if n in entries.columns])
    conf = number("confidence", "conf", "score", "det_conf").alias("conf")
    by_file = entries.select(F.col("file").alias("e_file"), conf).groupBy("e_file").agg(F.max("conf").alias("file_conf"))
    by_key = entries.select(F.coalesce(*[F.col(n) for n in ("frame", "frame_number") if n in entries.columns]).alias("e_frame"), F.coalesce(*[F.col(n) for n in ("local_id", "track_id") if n in entries.columns]).alias("e_local"), conf)
    by_key = by_key.groupBy("e_frame", "e_local").agg(F.max("conf").alias("key_conf"))
    out = crops.join(by_file, F.col("name") == F.col("e_file"), "left").join(by_key, (F.col("frame") == F.col("e_frame")) & (F.col("local_id") == F.col("e_local")), "left")
    return out.withColumn("conf", F.coalesce("file_conf", "key_conf")).drop("e_file", "file_conf", "e_frame", "e_local", "key_conf")


def nearest_manifest(paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each path the manifest of its nearest folder: ancestors are expanded and met by an equi-join."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = paths.select("path", F.explode(up).alias("folder")).join(manifests.select(F.col("folder").alias("m_folder"), "db"), F.col("folder") == F.col("m_folder"))
    best = met.groupBy("path").agg(F.max_by("db", F.length("folder")).alias("db"))
    return paths.join(best, "path", "left")
