"""The folds and linking against plain versions on lists of crops: random cases, and the test tables."""

from collections import defaultdict
from dataclasses import replace

import numpy as np
import plain
import pytest

from trackweave.config import FIXTURE, Thresholds
from trackweave.operators import folds
from trackweave.operators.folds import Cluster
from trackweave.operators.link import Linker
from trackweave.plans import refine
from trackweave.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


def cluster(crops, name, seq=0):
    e, u, lo, f = zip(*crops, strict=True)
    return Cluster(len(crops), np.sum(e, axis=0), np.sum(u, axis=0), np.sum(lo, axis=0), frozenset(f), [name] if isinstance(name, str) else list(name), seq)


def cases(seed, n=24, d=6, bins=4):
    """Crops round a few centres, as tracks of one to six crops."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((4, d))
    tracks = []
    for _ in range(n):
        k, tint = r.integers(0, 4), r.random(bins) + 0.2
        own = []
        for _ in range(int(r.integers(1, 7))):
            v = centres[k] + 0.5 * r.standard_normal(d)
            hist = lambda tint=tint: (x := tint + 0.3 * r.random(bins)) / x.sum()
            own.append((v / np.linalg.norm(v), hist(), hist(), int(r.integers(0, 60))))
        tracks.append(own)
    return tracks


def frames_of(groups):
    """What a result holds, in order, whatever the names: sizes and the crops' vectors."""
    return [sorted(c[0].tobytes() for c in g) for g in groups]


@pytest.mark.parametrize("seed", range(25))
def test_folds_equal_plain_versions(seed):
    tracks = cases(seed)
    keys = {str(i): x for i, x in enumerate(tracks)}
    crops = [c for x in tracks for c in x]
    singles = {f"c{i}": [c] for i, c in enumerate(crops)}
    t = Thresholds(split_reid=0.75, split_color=0.75, merge_reid=0.7, merge_color=0.8, coherence_min=0.6, max_overlap=1, min_track=2, large_size=9, large_reid=0.6, large_color=0.7, reattach_reid=0.6, reattach_color=0.6)
    given, alone = [cluster(x, k) for k, x in keys.items()], [cluster(x, k) for k, x in singles.items()]
    back = lambda got, names: frames_of([[c for m in g.members for c in names[m]] for g in got])
    assert back(folds.leader_split(alone, t), singles) == frames_of(plain.leader(crops, t))
    for fold, want in ((folds.seed_absorb, plain.seeds), (folds.agglomerate, plain.agglomerate), (folds.sequential_merge, plain.sequential), (folds.forward_groups, plain.forward), (folds.running_merge, plain.running)):
        assert back(fold(given, t), keys) == frames_of(want(tracks, t)), fold.__name__


@pytest.mark.parametrize("seed", range(25))
def test_linking_equals_a_plain_version(seed):
    r = np.random.default_rng(seed)
    faces = r.standard_normal((5, 6))
    frames = []
    for frame in sorted(r.choice(200, 60, replace=False).tolist()):
        rows = []
        for local in sorted(r.choice(8, int(r.integers(1, 5)), replace=False).tolist()):
            v = faces[local % 5] + 0.35 * r.standard_normal(6)
            x, y = (int(a) for a in r.integers(0, 40, 2))
            hist = [(h := r.random(4) + 0.3) / h.sum() for _ in range(2)]
            rows.append((local + 8 * (frame // 70), (x, y, x + 30, y + 60), bool(r.random() < 0.85), v / np.linalg.norm(v), *hist))
        frames.append((frame, rows))
    t = Thresholds(short_link=0.6, long_link=0.7, drift_reid=0.4, embed_every=3, short_gap_frames=15, stale_frames=40)
    linker = Linker(t, 10)
    got = [(x[0], x[2]) for frame, rows in frames for x in linker.step(frame, rows)]
    assert got == plain.link(frames, t, 15, 40)



@pytest.fixture(scope="module")
def crops(spark):
    rows = fx.crops(spark, SF).orderBy("folder", "local_id", "crop_id").collect()
    return [(r.folder, r.local_id, r.crop_id, (np.array(r.emb), np.array(r.up), np.array(r.lo), r.frame)) for r in rows]


def tracks_of(crops):
    out = defaultdict(list)
    for folder, local, _, c in crops:
        out[folder, local].append(c)
    return out


def members(df):
    return sorted(r.members for r in df.select("members").collect())


def test_queries_equal_plain_versions(spark, crops):
    tracks, q, names = tracks_of(crops), refine.QUERIES, {}
    for (folder, local), own in tracks.items():
        for c in own:
            names[id(c)] = {f"{folder}/{local}"}
    shown = lambda groups: sorted(" ".join(sorted({n for c in g for n in names[id(c)]})) for g in groups)
    ordered = [tracks[k] for k in sorted(tracks)]
    folders = [[tracks[k] for k in sorted(tracks) if k[0] == f] for f in sorted({k[0] for k in tracks})]
    zero = replace(FIXTURE, max_overlap=0)
    assert members(q["seed_absorb_split"](spark, SF)) == shown([g for f in folders for g in plain.seeds(f, FIXTURE)])
    assert members(q["agglomerative_merge"](spark, SF)) == shown(plain.agglomerate(ordered, FIXTURE))
    final = plain.sequential(ordered, FIXTURE)
    assert members(q["sequential_merge"](spark, SF)) == shown(final)
    forward = [g for f in folders for g in plain.forward(f, FIXTURE)]
    assert members(q["two_stage_merge"](spark, SF)) == shown(plain.running(forward, zero))
    people = lambda groups, least: [(k, n, len(g)) for k, g in enumerate((g for g in sorted(groups, key=len, reverse=True) if len(g) >= least), 1) for n in {n for c in g for n in names[id(c)]}]
    table = lambda df: sorted(map(tuple, df.select("person_id", "member", "n").collect()))
    assert table(q["refined_identities"](spark, SF)) == table(q["pipeline_g4"](spark, SF)) == sorted(people(final, FIXTURE.min_final))
    assert table(q["pipeline_g2"](spark, SF)) == sorted(people(plain.running(forward, zero), 3))
    assert table(q["pipeline_g3"](spark, SF)) == sorted(people(plain.sequential([g for f in folders for g in plain.seeds(f, FIXTURE)], FIXTURE), FIXTURE.min_final))
    trace = q["merge_trace"](spark, SF).collect()
    assert sum(r.decision != "merged" for r in {r.step: r for r in trace}.values()) == len(final)
    own = [[c for _, _, i, c in sorted((x for x in crops if x[0] == f), key=lambda x: (x[3][3], x[2]))] for f in sorted({k[0] for k in tracks})]
    one = {id(c): str(i) for _, _, i, c in crops}
    split = [g for f in own for g in plain.leader(f, refine.CROP_FIXTURE)]
    assert members(q["leader_split"](spark, SF)) == sorted(" ".join(sorted(one[id(c)] for c in g)) for g in split)


def test_linked_video_equals_a_plain_version(spark):
    rows = fx.features(spark, SF).where("video_id = 3 and frame_idx < 2500").orderBy("frame_idx", "det_seq").collect()
    frames = defaultdict(list)
    for r in rows:
        frames[r.frame_idx].append((r.local_id, tuple(r.bbox), r.reid_ok, np.array(r.embedding), np.array(r.upper), np.array(r.lower)))
    want = plain.link(sorted(frames.items()), FIXTURE, FIXTURE.short_gap_frames, FIXTURE.stale_frames)
    got = refine.online_link_batch(spark, SF).where("video_id = 3 and frame_idx < 2500").orderBy("frame_idx", "det_seq").select("gid", "reason").collect()
    assert len(rows) > 100 and [tuple(r) for r in got] == want


def test_matches_are_not_empty(spark):
    assert refine.greedy_frame_match(spark, SF).count() > 20 and refine.review_overlay(spark, SF).where("person_id is not null").count() > 20
