"""Ranges over image pairs of two folders."""

import numpy as np
import pytest

from trackweave.operators import pairs
from trackweave.plans import diagnostics


def test_range_of_large_folders(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    crops = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "crop_id long, folder int, emb array<double>")
    sim = x[::2] @ x[1::2].T
    monkeypatch.setattr(pairs, "BLOCK", 700)  # some blocks on both sides
    monkeypatch.setattr(diagnostics, "specs", lambda s: s.createDataFrame([("0 is 1", 0, 1)], "spec string, folder1 int, folder2 int"))
    monkeypatch.setattr(diagnostics.fx, "crops", lambda s, sf: crops)
    (row,) = diagnostics.pairwise_range(spark, "").collect()
    assert (row.spec, row.folder1, row.folder2) == ("0 is 1", 0, 1)
    assert (row.min_sim, row.max_sim, row.mean_sim) == pytest.approx((sim.min(), sim.max(), sim.mean()), abs=1.1e-6)
