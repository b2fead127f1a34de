"""Pixel arithmetic against loops over pixels; files that writers leave; paths and manifests found."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import pixels
from trackweave.sources import crops, sinks


def plain_sharpness(img):
    h, w, _ = img.shape
    g = [[(114 * int(b) + 587 * int(v) + 299 * int(r) + 500) // 1000 for b, v, r in row] for row in img]
    at = lambda y, x: g[abs(y) if y < h else 2 * h - 2 - y][abs(x) if x < w else 2 * w - 2 - x]
    d = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * g[y][x] for y in range(h) for x in range(w)]
    return sum(x * x for x in d) / len(d) - (sum(d) / len(d)) ** 2


def plain_resized(img, height, width):
    h, w, _ = img.shape
    out = np.zeros((height, width, 3), np.uint8)
    for y in range(height):
        for x in range(width):
            fy, fx = min(max((y + 0.5) * h / height - 0.5, 0), h - 1), min(max((x + 0.5) * w / width - 0.5, 0), w - 1)
            y0, x0 = int(fy), int(fx)
            y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), fy - y0, fx - x0
            for c in range(3):
                low, high = img[y0, x0, c] * (1 - fx) + img[y0, x1, c] * fx, img[y1, x0, c] * (1 - fx) + img[y1, x1, c] * fx
                out[y, x, c] = math.floor(low * (1 - fy) + high * fy + 0.5)
    return out


@pytest.mark.parametrize("shape", [(2, 2), (5, 9), (40, 17), (128, 64), (200, 3)])
def test_pixels(shape):
    img = np.random.default_rng(sum(shape)).integers(0, 256, (*shape, 3)).astype(np.uint8)
    assert pixels.sharpness_of(img) == pytest.approx(plain_sharpness(img), rel=1e-9)
    small = pixels.resized(img, 16, 8)
    assert np.abs(small.astype(int) - plain_resized(img, 16, 8)).max() <= 1  # halves may round either way
    up, lo = pixels.signature_of(img)
    assert len(up) == len(lo) == 512 and sum(up) == pytest.approx(1) and sum(lo) == pytest.approx(1)
    x = np.array(pixels.network_input_of(img)).reshape(3, 256, 128)
    assert x[0, 0, 0] == pytest.approx((pixels.resized(img, 256, 128)[0, 0, 2] / 255 - 0.485) / 0.229, abs=1e-6)


def test_known_colors():
    """Lightness, a and b of plain colours, as published tables give them (scaled to bytes)."""
    bgr = np.array([[[0, 0, 0], [255, 255, 255], [0, 0, 255], [0, 255, 0], [255, 0, 0]]], np.uint8)
    assert pixels.lab(bgr)[0].tolist() == [[0, 128, 128], [255, 128, 128], [136, 208, 195], [224, 42, 211], [82, 207, 20]]


def test_odd_pictures(spark):
    rows = [(1, 1, 1, bytes([9, 9, 9])), (2, 2, 2, b"short"), (3, None, 2, bytes(12)), (4, 0, 0, b""), (5, 2, 2, None), (6, -1, -1, bytes(3))]
    d = spark.createDataFrame(rows, "id int, height int, width int, pixels binary")
    at = [F.col(c) for c in ("height", "width", "pixels")]
    got = d.select("id", pixels.sharpness(*at).alias("s"), pixels.color_signature(*at).alias("c"), pixels.network_input(*at).alias("x")).orderBy("id").collect()
    assert got[0].s == 0 and len(got[0].x) == 3 * 256 * 128 and [sum(h) for h in got[0].c] == pytest.approx([1, 1])
    assert all(r.s is None and r.c is None and r.x is None for r in got[1:])
    assert d.limit(0).select(pixels.sharpness(*at)).collect() == []


def test_writers_and_scan(spark, tmp_path):
    d = spark.createDataFrame([(1, 7, 30, 1.25, b"one"), (1, 7, 31, 1.5, b"two"), (1200, 8, 30, 1.25, b"three"), (2, 9, 1, 0.0, None)], "gid int, local_id int, frame int, seconds double, content binary")
    root = f"file://{tmp_path}/crops"
    for _ in range(2):  # again gives the same files
        done = {r.dest: r.bytes for r in sinks.write_crops(d, root).collect()}
    assert {Path(k).relative_to(tmp_path).as_posix(): v for k, v in done.items() if k} == {"crops/person_001/frame_000030_t1.250_l7.jpg": 3, "crops/person_001/frame_000031_t1.500_l7.jpg": 3, "crops/person_1200/frame_000030_t1.250_l8.jpg": 5}
    assert sorted(p.name for p in (tmp_path / "crops").rglob("*") if p.is_file()) == ["frame_000030_t1.250_l7.jpg", "frame_000030_t1.250_l8.jpg", "frame_000031_t1.500_l7.jpg"]
    (tmp_path / "crops" / "person_001" / "notes.txt").write_text("x")
    (tmp_path / "crops" / "other").mkdir()
    (tmp_path / "crops" / "other" / "frame_1_l1.jpg").write_text("x")
    seen = crops.scan_folders(spark, root, content=True)
    assert sorted((r.folder, r.frame, r.local_id, bytes(r.content)) for r in seen.collect()) == [("person_001", 30, 7, b"one"), ("person_001", 31, 7, b"two"), ("person_1200", 30, 8, b"three")]
    assert sorted(r.p for r in seen.select(crops.person_id(F.col("folder")).alias("p")).collect()) == [1, 1, 1200]
    copied = seen.select(F.lit("all").alias("dest_folder"), F.concat_ws("_", "folder", "name").alias("dest_name"), F.col("path").alias("src"))
    assert sorted(r.bytes for r in sinks.write_files(copied, f"{tmp_path}/copies").collect()) == [3, 3, 5]
    assert (tmp_path / "copies" / "all" / "person_1200_frame_000030_t1.250_l8.jpg").read_bytes() == b"three"
    assert {Path(r.dest).parent.name for r in sinks.write_crops(d.where("gid < 2"), f"{tmp_path}/tracks", by="track").collect()} == {"track_007"}
    assert [r.folder for r in spark.createDataFrame([("track_10",), ("track_9",)], "folder string").orderBy(crops.track_folder_order(F.col("folder"))).collect()] == ["track_9", "track_10"]


def test_databases(spark, tmp_path):
    rows = spark.createDataFrame([("person_001", 2, ["b", "a"]), ("person_002", 0, None)], "folder string, image_count int, files array<string>")
    assert len(sinks.write_databases(rows, str(tmp_path)).collect()) == 2
    text = (tmp_path / "person_001" / sinks.DATABASE).read_text()
    assert text == json.dumps({"files": ["b", "a"], "folder": "person_001", "image_count": 2}, indent=2, sort_keys=True)
    texts = spark.createDataFrame([("x", text), ("y", "{broken")], "db string, value string")
    got = {r.db: r.manifest for r in crops.read_manifest(texts).collect()}
    assert got["x"].files == ["b", "a"] and got["y"].files is None
    paths = spark.createDataFrame([("/d/a/b/c.jpg",), ("/d/z.jpg",), ("/e/z.jpg",)], "path string")
    found = crops.nearest_manifest(paths, spark.createDataFrame([("/d", "outer"), ("/d/a", "inner")], "folder string, db string"))
    assert {r.path: r.db for r in found.collect()} == {"/d/a/b/c.jpg": "inner", "/d/z.jpg": "outer", "/e/z.jpg": None}


def test_paths():
    there = {Path("/p/x"), Path("/q/x"), Path("near")}
    exists = there.__contains__
    assert crops.resolved_path("x", "d", ["/o", "/p", "/q"], exists) == Path("/p/x")
    assert crops.resolved_path(None, "d", ["/o", "/p"], exists) == Path("/o/d")
    assert crops.resolved_path("/abs", "d", ["/o"], exists) == Path("/abs")
    assert [str(crops.resolved_folder("/r", t, exists)) for t in ("7", " 1234 ", "person_2", "near", "/abs", "odd")] == ["/r/person_007", "/r/person_1234", "/r/person_2", "near", "/abs", "/r/odd"]
    with pytest.raises(ValueError, match="empty"):
        crops.resolved_folder("/r", " ", exists)
