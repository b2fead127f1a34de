"""Linking of long videos."""

import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackweave.config import FIXTURE
from trackweave.operators import link
from trackweave.plans import refine

SF = "/root/testdata/sf0.001"


def video(k, frames, each, seed=0):
    """Detections of a video as rows, frame by frame; few people, whose vectors come again."""
    r = np.random.default_rng(seed + k)
    faces = r.standard_normal((40, 64))
    for f in range(frames):
        for n in range(each):
            v = faces[r.integers(0, 40)] + 0.3 * r.standard_normal(64)
            hist = lambda x: np.abs(x) / np.abs(x).sum()
            box = dict(zip(("x1", "y1", "x2", "y2"), (10 * n, 20, 10 * n + 30, 90), strict=True))
            yield {"video_id": k, "frame_idx": f, "det_seq": f * each + n, "local_id": n + f // 40 * each, "bbox": box, "conf": 1.0, "reid_ok": bool(r.random() < 0.9), "embedding": v / np.linalg.norm(v), "upper": hist(v[:32]), "lower": hist(v[32:])}


def parts(rows, size):
    held = []
    for x in rows:
        held.append(x)
        if len(held) == size:
            yield pd.DataFrame(held)
            held = []
    if held:
        yield pd.DataFrame(held)


def batch_task(spark, monkeypatch):
    """What online_link_batch runs over sorted rows in parts."""
    tasks = []
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, f, schema: tasks.append(f))
    refine.online_link_batch(spark, SF)
    return tasks[0]


def test_parts_do_not_change_linking(spark, monkeypatch):
    task = batch_task(spark, monkeypatch)
    rows = [x for k in (1, 4) for x in video(k, 90, 5)]
    want = pd.concat([refine.as_linked(list(refine.link_rows(link.Linker(FIXTURE), pd.DataFrame([x for x in rows if x["video_id"] == k])))) for k in (1, 4)])
    assert len(want["reason"].unique()) > 3
    for size, chunk in ((1, 3), (7, 8192), (450, 10), (1000, 1)):
        monkeypatch.setattr(link, "CHUNK", chunk)
        got = pd.concat(list(task(parts(rows, size))))
        assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()
    assert list(task(parts([], 5))) == []


def test_a_video_is_not_held_in_memory(spark, monkeypatch):
    task = batch_task(spark, monkeypatch)
    tracemalloc.start()
    n = sum(len(x) for x in task(parts(video(1, 400, 20), 400)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8000 and peak < 8000 * 1024


def test_a_large_table_streams_in_small_batches(spark, monkeypatch):
    from trackweave.sources import fixtures as fx
    from trackweave.streaming import online

    monkeypatch.setattr(online, "ROWS", 200, raising=False)
    monkeypatch.setattr(online, "INLINE", 5, raising=False)
    rows = fx.features(spark, SF)
    linked = online.link_stream(spark, rows, FIXTURE)
    got = [tuple(r) for r in linked.orderBy("det_seq").collect()]
    assert got == [tuple(r) for r in refine.online_link_batch(spark, SF).orderBy("det_seq").collect()]
    root = Path("/" + linked.inputFiles()[0].removeprefix("file:").lstrip("/")).parents[1]
    fed = spark.read.option("recursiveFileLookup", True).parquet(str(root / "in")).groupBy(F.regexp_extract(F.input_file_name(), "/in/([^/]+)", 1)).count()
    sizes = [r["count"] for r in fed.collect()]
    assert len(got) > 900 and max(sizes) < 260 and sum(sizes) == len(got) + 8
    assert 8 <= len(list((root / "linkers").iterdir())) <= 16
