"""Thresholds of all operators, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Defaults are the effective values of the described system; fixed values."""

    short_gap_sec: float = 3.0
    local_stale_sec: float = 8.0
    short_link: float = 0.74
    long_link: float = 0.82
    iou_weight: float = 0.12
    color_floor: float = 0.35
    ambiguity_margin: float = 0.03
    drift_reid: float = 0.62
    drift_color: float = 0.24
    prototype_alpha: float = 0.20
    color_alpha: float = 0.12
    embed_every: int = 3
    detection_confidence: float = 0.4
    save_gate: tuple = (10, 20, 0.0010, 8.0)
    reid_gate: tuple = (10, 20, 0.0012, 12.0)
    refine_area: float = 0.0012
    refine_sharpness: float = 12.0
    refine_aspect: float = 4.0
    min_track: int = 18
    split_reid: float = 0.90
    split_color: float = 0.65
    split_weight: float = 0.15
    split_min: int = 3
    reattach_min: int = 3
    reattach_reid: float = 0.80
    reattach_color: float = 0.34
    merge_reid: float = 0.90
    merge_color: float = 0.65
    merge_weight: float = 0.20
    coherence_min: float = 0.80
    max_overlap: int = 3
    min_final: int = 18
    large_size: int = 200
    large_reid: float = 0.85
    large_color: float = 0.65
    match_reid: float = 0.90
    match_color: float = 0.65
    iou_match: float = 0.5
    strict_parity: bool = False
    global_ttl_frames: int = 0
    short_gap_frames: int | None = None
    stale_frames: int | None = None


#: For the synthetic vectors of the test tables, which are nearly random.
FIXTURE = Thresholds(
    split_reid=0.10, split_color=0.85, merge_reid=0.15, merge_color=0.85, coherence_min=0.25, min_track=8, min_final=8, large_size=20, large_reid=0.12, large_color=0.85,
    short_link=0.20, long_link=0.30, drift_reid=-0.20, short_gap_frames=30, stale_frames=80, reattach_reid=0.10, reattach_color=0.80, match_reid=0.05, match_color=0.60,
)


def gap_frames(fps: float) -> tuple[int, int]:
    """Recency window and stale limit in frames; halves go to the even number."""
    short = max(1, round(3.0 * fps))
    return short, max(2 * short, round(8.0 * fps))
