"""Matches of many detections in one frame."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from trackweave.config import FIXTURE
from trackweave.operators import folds
from trackweave.plans import refine

SF = "/root/testdata/sf0.001"


def walked(score, allowed):
    left, right, out = set(), set(), []
    for _, i, j in sorted((-score[i, j], i, j) for i in range(score.shape[0]) for j in range(score.shape[1])):
        if allowed[i, j] and i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return out


@pytest.mark.parametrize("kinds", [1, 3, 1000])
def test_match_equals_the_walk_over_all_pairs(monkeypatch, kinds):
    r = np.random.default_rng(kinds)
    for kept in (1, 2, 5):
        monkeypatch.setattr(folds, "KEPT", kept, raising=False)
        monkeypatch.setattr(folds, "BLOCK", 7 * kept, raising=False)
        for _ in range(60):
            n, m = r.integers(0, 22, 2)
            score, allowed = r.integers(0, kinds, (n, m)) / 7, r.random((n, m)) < r.choice([0.2, 0.7, 1.0])
            assert folds.greedy_match(score, allowed) == walked(score, allowed)


def frame(n, seed=0):
    """One frame of n detections, with copies of vectors."""
    r = np.random.default_rng(seed)
    v = r.standard_normal((n // 2, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True))[r.integers(0, n // 2, n)]
    hist = lambda x: list(np.abs(x) / np.abs(x).sum(1, keepdims=True))
    return pd.DataFrame({"frame_idx": 5, "det_seq": np.arange(n), "local_id": np.arange(n) % 50, "person_id": np.arange(n) % 10, "embedding": list(v), "upper": hist(v[:, :32]), "lower": hist(v[:, 32:])})


def test_a_large_frame_takes_no_memory_for_its_pairs(spark, monkeypatch):
    folded = []
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", lambda self, f, schema: folded.append(f))
    refine.greedy_frame_match(spark, SF)
    d = frame(2000)
    tracemalloc.start()
    got = folded[0](d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    a, b = d[d["det_seq"] % 2 == 0], d[d["det_seq"] % 2 == 1].sort_values(["person_id", "local_id", "det_seq"])
    part = lambda x, c: np.stack(x[c].tolist())
    reid = part(a, "embedding") @ part(b, "embedding").T
    color = sum(w * np.stack([np.minimum(x, part(b, c)).sum(1) for x in part(a, c)]) for w, c in ((0.4, "upper"), (0.6, "lower")))
    want = walked(np.round(reid + FIXTURE.merge_weight * color, 9), (reid >= FIXTURE.match_reid) & (color >= FIXTURE.match_color))
    assert len(want) > 900
    assert list(zip(got["det_id"], got["sample_id"], strict=True)) == [(a["det_seq"].iloc[i], b["det_seq"].iloc[j]) for i, j in want]


def test_review_overlay_takes_no_memory_for_pairs(spark, monkeypatch):
    folded, kind = [], type(spark.range(1).groupBy("id"))
    monkeypatch.setattr(kind, "applyInPandas", lambda self, f, schema, own=kind.applyInPandas: folded.append(f) or own(self, f, schema))
    shown = refine.review_overlay(spark, SF)
    d = frame(2000, 1)
    tracemalloc.start()
    got = folded[0](d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(folded) == 1 and "review_label" in shown.columns and len(got) > 900 and peak < 60e6


def test_review_overlay_holds_candidates_in_less_memory_than_vectors(spark, monkeypatch):
    folded, kind = [], type(spark.range(1).groupBy("id"))
    monkeypatch.setattr(kind, "applyInPandas", lambda self, f, schema, own=kind.applyInPandas: folded.append(f) or own(self, f, schema))
    refine.review_overlay(spark, SF)
    walk, peaks, sizes = folds.greedy_walk, [], []

    def traced(n, m, scored):
        tracemalloc.start()
        got = walk(n, m, scored)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        sizes.append((n, m, len(got)))
        return got

    monkeypatch.setattr(folds, "greedy_walk", traced)
    folded[0](frame(8000, 2))
    n, m, pairs = sizes[0]
    assert (n, m) == (4000, 4000) and pairs > 3500 and peaks[0] < 14e6
