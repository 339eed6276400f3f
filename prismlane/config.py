"""Settings of the pipelines; the defaults are the published ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KeyframeConfig:
    stride_sec: float = 1.0
    max_frames: int | None = None
    max_seconds: float | None = None
    chunk_sec: float = 300.0
    min_aesthetic: float = 0.0
    min_tech: float = 70.0
    dedup: float = 0.15
    final_dedup: float | None = None  # as dedup if not given
    require_face: bool = False
    allow_faceless: bool = False
    scenic_only: bool = False
    min_face_area: float = 0.0
    min_face_y: float = 0.0
    adaptive_least: float | None = None
    ghosts: bool = False


@dataclass(frozen=True)
class TwoPassConfig:
    sec_per_image: float = 10.0
    max_seconds: float | None = None
    dedup: float = 0.15
    min_sharpness: float = 50.0
    min_aesthetic: float = 0.0
    min_person: float = 0.05
    min_face: float = 0.02
    person_filter: bool = True
    face_filter: bool = False
    indoor_needs_face: bool = True
    allow_scenery: bool = True
    scene_or_person: bool = True


@dataclass(frozen=True)
class SpeakerConfig:
    presence_pad: float = 0.15
    min_turn: float = 0.25
    turn_gap: float = 0.05
    near: float = 0.20


@dataclass(frozen=True)
class ClusterConfig:
    similarity: float = 0.30
    min_size: int = 3
    per_video: bool = True
    pre: float = 0.0
    post: float = 0.0
    min_dur: float = 0.5
    merge_gap: float = 0.5
    min_area: float = 0.02
    min_sharpness: float = 60.0
    dedup_method: str = "both"
    dedup_bits: int = 6
    dedup_least: float = 0.995
    dedup_window: float = 5.0


@dataclass(frozen=True)
class PersonConfig:
    sample_fps: float = 2.0
    match: float = 0.55
    margin: float = 0.05
    every_photo: bool = True
    consecutive: int = 2
    min_area: float = 0.02
    min_sharpness: float = 60.0
    pre: float = 1.0
    post: float = 1.0
    join_gap: float = 2.0
    validate: bool = True
    least_ratio: float = 0.6
    max_clips: int | None = None


@dataclass(frozen=True)
class ImageConfig:
    rules: str = "gate"  # gate, ordered or all
    without_brisque: bool = False
