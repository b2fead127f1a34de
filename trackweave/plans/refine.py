"""Splits, merges, matches and linking over the test tables: folds wrapped in grouped maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.config import FIXTURE, Thresholds
from trackweave.operators import folds, tracks
from trackweave.operators.link import Linker
from trackweave.sources import fixtures as fx
from trackweave.streaming.online import link_stream

#: Single crops are less alike in colour than tracks.
CROP_FIXTURE = replace(FIXTURE, split_color=0.6, reattach_reid=0.05, reattach_color=0.6, merge_color=0.6)

CLUSTERS = "folder int, cluster int, n long, emb array<double>, up array<double>, lo array<double>, frames array<long>, members array<string>"


def read(d: pd.DataFrame) -> list[folds.Cluster]:
    return [folds.Cluster(int(r.n), np.asarray(r.emb, float), np.asarray(r.up, float), np.asarray(r.lo, float), frozenset(r.frames), list(r.members), k) for k, r in enumerate(d.itertuples())]


def told(clusters: list[folds.Cluster], folder: int = 0) -> pd.DataFrame:
    rows = [(folder, k, c.n, c.emb, c.up, c.lo, sorted(c.frames), c.members) for k, c in enumerate(clusters)]
    return pd.DataFrame(rows, columns=["folder", "cluster", "n", "emb", "up", "lo", "frames", "members"])


def track_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = tracks.stats(fx.crops(spark, sf), ["folder", "local_id"], fx.SIZE, fx.HALF)
    return s.select("folder", F.col("local_id").alias("cluster"), "n", F.col("sum_emb").alias("emb"), F.col("sum_up").alias("up"), F.col("sum_lo").alias("lo"), "frames", F.array(F.format_string("%d/%d", "folder", "local_id")).alias("members"))


def crop_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.crops(spark, sf)
    return c.select("folder", F.col("crop_id").cast("int").alias("cluster"), F.lit(1).cast("long").alias("n"), "emb", "up", "lo", F.array("frame").alias("frames"), F.array(F.col("crop_id").cast("string")).alias("members"))


def by_folder(rows: DataFrame, fold: Callable, t: Thresholds, order: list[str]) -> DataFrame:
    """A fold in each folder, in parallel; rows are sorted first, as Spark gives no order within a group."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.assign(first=[min(f, default=-1) for f in d["frames"]]).sort_values(order, kind="stable")
        return told(fold(read(d), t), int(d["folder"].iloc[0]))

    return rows.groupBy("folder").applyInPandas(run, CLUSTERS)


def over_all(rows: DataFrame, fold: Callable, t: Thresholds) -> DataFrame:
    """A fold over all clusters: one task, over statistics only (about 12 KB a cluster at 512 numbers)."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        return told(fold(read(d.sort_values(["folder", "cluster"], kind="stable")), t))

    return rows.groupBy().applyInPandas(run, CLUSTERS)


def shown(d: DataFrame) -> DataFrame:
    return d.select("folder", "cluster", "n", F.size("frames").alias("n_frames"), F.array_join(F.sort_array("members"), " ").alias("members"))


def leader_split(spark: SparkSession, sf: str) -> DataFrame:
    return shown(by_folder(crop_rows(spark, sf), folds.leader_split, CROP_FIXTURE, ["first", "cluster"]))


def seed_absorb_split(spark: SparkSession, sf: str) -> DataFrame:
    return shown(by_folder(track_rows(spark, sf), folds.seed_absorb, FIXTURE, ["cluster"]))


def agglomerative_merge(spark: SparkSession, sf: str) -> DataFrame:
    return shown(over_all(track_rows(spark, sf), folds.agglomerate, FIXTURE))


def sequential_merge(spark: SparkSession, sf: str) -> DataFrame:
    return shown(over_all(track_rows(spark, sf), folds.sequential_merge, FIXTURE))


def two_stage_merge(spark: SparkSession, sf: str) -> DataFrame:
    return shown(over_all(by_folder(track_rows(spark, sf), folds.forward_groups, FIXTURE, ["cluster"]), folds.running_merge, replace(FIXTURE, max_overlap=0)))


def refined(clusters: DataFrame, least: int) -> DataFrame:
    """(person_id, member, n): numbered by falling size, those below the least size dropped before numbering."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, m, c.n) for k, c in folds.numbered(read(d.sort_values(["folder", "cluster"], kind="stable")), least) for m in c.members]
        return pd.DataFrame(rows, columns=["person_id", "member", "n"])

    return clusters.groupBy().applyInPandas(run, "person_id int, member string, n long")


def destination(mapping: DataFrame, person: str = "person_id", name: str = "name") -> DataFrame:
    """Adds dest_name: files of a person that share a name get _1, _2, ... before the ending, in source order."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(person, name).orderBy("src")) - 1
    stem, end = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return mapping.withColumn("k", k).withColumn("dest_name", F.when(F.col("k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("k").cast("string"), end))).drop("k")


def refined_identities(spark: SparkSession, sf: str) -> DataFrame:
    return refined(over_all(track_rows(spark, sf), folds.sequential_merge, FIXTURE), FIXTURE.min_final)


def merge_trace(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each candidate (the best five) of each cluster, in the order of decisions."""
    columns = "step int, n long, coherence double, decision string, target int, candidate int, frame_overlap int, reid_sim double, color_sim double, score double, reid_threshold double, color_threshold double, mode string, pass boolean, reasons string"

    def run(d: pd.DataFrame) -> pd.DataFrame:
        trace: list = []
        folds.sequential_merge(read(d.sort_values(["folder", "cluster"], kind="stable")), FIXTURE, trace)
        rows = [(k, n, co, what, at, *(x if x else (None,) * 10)) for k, (_, n, co, what, at, best) in enumerate(trace) for x in (best or [None])]
        rows = [(*r[:12], None if r[12] is None else "LARGE" if r[12] else "NORMAL", *r[13:]) for r in rows]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])

    return track_rows(spark, sf).groupBy().applyInPandas(run, columns)


def greedy_frame_match(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of a frame (even ids, by id) to samples of persons in the frame (odd ids, by person and track), one to one, by reid + colour; equal scores in that order."""
    f = fx.features(spark, sf, person=True).withColumn("frame_idx", F.floor(F.col("frame_idx") / 6).cast("int"))
    t, columns = FIXTURE, ["frame_idx", "det_id", "sample_id", "person_id", "reid_sim"]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        a, b = d[d["det_seq"] % 2 == 0].sort_values("det_seq"), d[d["det_seq"] % 2 == 1].sort_values(["person_id", "local_id", "det_seq"])
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        part = lambda x: [np.stack([np.asarray(v, float) for v in x[c]]) for c in ("embedding", "upper", "lower")]
        (emb, up, lo), (emb2, up2, lo2) = part(a), part(b)

        def scored(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            reid = emb[i:j] @ emb2.T
            color = 0.4 * folds.shared(up[i:j], up2) + 0.6 * folds.shared(lo[i:j], lo2)
            return np.round(reid + t.merge_weight * color, 9), (reid >= t.match_reid) & (color >= t.match_color)

        got = folds.greedy_walk(len(a), len(b), scored)
        frame, left, right, person = int(d["frame_idx"].iloc[0]), a["det_seq"].tolist(), b["det_seq"].tolist(), b["person_id"].tolist()
        return pd.DataFrame([(frame, left[i], right[j], person[j], round(float(emb[i] @ emb2[j]), 6)) for i, j in got], columns=columns)

    rows = f.select("frame_idx", "det_seq", "local_id", "person_id", "embedding", "upper", "lower")
    return rows.groupBy("frame_idx").applyInPandas(run, "frame_idx int, det_id long, sample_id long, person_id int, reid_sim double")


def review_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of the review video, each with the person it was matched to in its frame, or '?'."""
    d = fx.keyed(fx.detections(spark, sf)).where("det_id % 2 = 0").select("det_id", F.floor(F.col("frame_idx") / 6).cast("int").alias("frame_idx"), "local_id", "y1")
    met = d.join(greedy_frame_match(spark, sf).select("det_id", "person_id"), "det_id", "left")
    label = F.when(F.col("person_id").isNotNull(), F.format_string("P%03d L%d", "person_id", "local_id")).otherwise(F.format_string("L%d ?", "local_id"))
    return met.select("det_id", "frame_idx", "person_id", label.alias("review_label"), F.when(F.col("y1") > 24, F.col("y1") - 10).otherwise(F.col("y1") + 20).cast("int").alias("review_y"))


def greedy_iou_match(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of two detectors (even and odd ids): both, only a, only b; matched boxes are averaged."""
    d0 = fx.detections(spark, sf).withColumn("frame_idx", F.floor(F.col("frame_idx") / 6))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("det_id", kind="stable")
        a, b = d[d["det_id"] % 2 == 0], d[d["det_id"] % 2 == 1]
        box = lambda x: x[["x1", "y1", "x2", "y2"]].to_numpy(float)
        p, q = box(a)[:, None], box(b)[None]
        w, h = (np.maximum(0, np.minimum(p[..., k + 2], q[..., k + 2]) - np.maximum(p[..., k], q[..., k])) for k in (0, 1))
        area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
        union = area(p) + area(q) - w * h
        iou = np.where(union > 0, w * h / np.where(union > 0, union, 1), 0)
        got = folds.row_match(iou, 0.1)
        frame, rows = int(d["frame_idx"].iloc[0]), []
        for i, j in got:
            rows.append((frame, "both", int(a["det_id"].iloc[i]), int(b["det_id"].iloc[j]), *((box(a)[i] + box(b)[j]) / 2).astype(int).tolist()))
        rows += [(frame, "only_a", int(a["det_id"].iloc[i]), None, *box(a)[i].astype(int).tolist()) for i in set(range(len(a))) - {i for i, _ in got}]
        rows += [(frame, "only_b", None, int(b["det_id"].iloc[j]), *box(b)[j].astype(int).tolist()) for j in set(range(len(b))) - {j for _, j in got}]
        return pd.DataFrame(rows, columns=["frame_idx", "kind", "a_id", "b_id", "x1", "y1", "x2", "y2"]).astype({"a_id": "Int64", "b_id": "Int64"})

    return d0.select("frame_idx", "det_id", "x1", "y1", "x2", "y2").groupBy("frame_idx").applyInPandas(run, "frame_idx long, kind string, a_id long, b_id long, x1 int, y1 int, x2 int, y2 int")


LINKED = "video_id long, frame_idx int, det_seq long, local_id int, gid long, is_new boolean, reason string, related_gid long"


def link_rows(linker: Linker, d: pd.DataFrame) -> Iterator[tuple]:
    d = d.sort_values(["frame_idx", "det_seq"], kind="stable")
    box = lambda b: (b["x1"], b["y1"], b["x2"], b["y2"]) if isinstance(b, dict) else tuple(b)
    vector = lambda v: None if v is None else np.asarray(v, float)
    video, frames, seqs, locals_ = (d[c].tolist() for c in ("video_id", "frame_idx", "det_seq", "local_id"))
    rows = [(int(k), box(b), bool(ok), vector(e), vector(u), vector(lo)) for k, b, ok, e, u, lo in zip(locals_, d["bbox"], d["reid_ok"], d["embedding"], d["upper"], d["lower"], strict=True)]
    at = 0
    while at < len(rows):
        to = at
        while to < len(rows) and frames[to] == frames[at]:
            to += 1
        for k, x in zip(range(at, to), linker.step(int(frames[at]), rows[at:to]), strict=False):
            yield int(video[k]), int(frames[k]), int(seqs[k]), int(locals_[k]), *x
        at = to


def as_linked(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in LINKED.split(", ")]).astype({"related_gid": "Int64"})


def link_videos(parts: Iterable[pd.DataFrame], t: Thresholds) -> Iterator[pd.DataFrame]:
    """Rows sorted by video, frame and det_seq, in parts of any size: no more than a part, a frame and the video's identities are in memory."""
    at, linker, frame = None, None, []
    for d in parts:
        edges = np.flatnonzero((d[["video_id", "frame_idx"]].diff() != 0).any(axis=1)).tolist()
        for i, j in zip(edges, [*edges[1:], len(d)], strict=True):
            now = d["video_id"].iloc[i], d["frame_idx"].iloc[i]
            if at is not None and now != at:
                yield as_linked(list(link_rows(linker, pd.concat(frame))))
                frame = []
            if at is None or now[0] != at[0]:
                linker = Linker(t)
            at = now
            frame.append(d.iloc[i:j])
    if frame:
        yield as_linked(list(link_rows(linker, pd.concat(frame))))


def online_link_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Videos in parallel, frames of a video in order, row by row through one task."""
    rows = fx.features(spark, sf).repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "det_seq")
    return rows.mapInPandas(lambda parts: link_videos(parts, FIXTURE), LINKED)


def online_link_stream(spark: SparkSession, sf: str) -> DataFrame:
    return link_stream(spark, fx.features(spark, sf), FIXTURE)


def pipeline(rows: DataFrame, split: Callable | None, order: list[str], merge: Callable, t: Thresholds) -> DataFrame:
    return refined(over_all(by_folder(rows, split, t, order) if split else rows, merge, t), t.min_final)


def pipeline_g1(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline(crop_rows(spark, sf), folds.leader_split, ["first", "cluster"], folds.agglomerate, replace(CROP_FIXTURE, max_overlap=0, min_final=3))


def pipeline_g2(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline(track_rows(spark, sf), folds.forward_groups, ["cluster"], folds.running_merge, replace(FIXTURE, max_overlap=0, min_final=3))


def pipeline_g3(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline(track_rows(spark, sf), folds.seed_absorb, ["cluster"], folds.sequential_merge, FIXTURE)


def pipeline_g4(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline(track_rows(spark, sf), None, [], folds.sequential_merge, FIXTURE)


QUERIES = {
    f.__name__: f
    for f in (
        leader_split, seed_absorb_split, agglomerative_merge, sequential_merge, two_stage_merge, refined_identities, merge_trace, greedy_frame_match, review_overlay, greedy_iou_match, online_link_batch, online_link_stream,
        pipeline_g1, pipeline_g2, pipeline_g3, pipeline_g4,
    )
}
