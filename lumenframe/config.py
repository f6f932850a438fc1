"""Typed settings, and a timer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame


# The names under which settings tables keep these fields.
STORED = {
    "face_detection": "face_det_thresh",
    "face_min_samples": "face_min_samples",
    "face_eps": "face_cluster_eps",
    "merge_threshold": "face_merge_threshold",
    "similarity": "threshold",
    "near_radius": "dup_threshold",
    "rerank_threshold": "dup_threshold_stage2",
    "force": "force_reanalyze",
    "include_trash": "include_trash",
}


@dataclass(frozen=True)
class Config:
    """Thresholds as fractions; fixed default values of the engine."""

    face_detection: float = 0.35
    face_min_samples: int = 2
    face_eps: float = 0.42
    merge_threshold: float = 0.55
    similarity: float = 0.6
    near_radius: float = 0.6
    rerank_threshold: float = 0.95
    video_ratio: float = 0.4 / 0.6
    force: bool = False
    include_trash: bool = False

    @classmethod
    def load(cls, settings: DataFrame) -> Config:
        """From a table of text settings, under their stored or their own names (stored ones win).

        What is missing or can't be read keeps its default, percentages become fractions.
        """
        known = {f.name: f.name for f in fields(cls)} | {stored: name for name, stored in STORED.items()}
        found = {r.key: r.value for r in settings.where(settings.key.isin(list(known))).collect() if r.value is not None}
        own = {k: v for k, v in found.items() if k not in STORED.values()}
        return cls().updated(**own | {known[k]: v for k, v in found.items() if k in STORED.values()})

    def updated(self, **values: object) -> Config:
        return replace(self, **{f.name: _read(str(values[f.name]), getattr(Config, f.name)) for f in fields(self) if f.name in values})

    def rows(self) -> list[tuple[str, str]]:
        """Stored key and text of every setting."""
        return [(STORED.get(f.name, f.name), str(getattr(self, f.name))) for f in fields(self)]


def _read(text: str, default: bool | int | float) -> bool | int | float:
    if isinstance(default, bool):
        return text.strip().lower() == "true"
    try:
        value = float(text)
    except ValueError:
        return default
    if isinstance(default, int):
        return int(value)
    return value / 100 if value > 1 and default <= 1 else value


@contextmanager
def timed(name: str, tell: Callable[[str], None] = print) -> Iterator[None]:
    start = time.perf_counter()
    try:
        yield
    finally:
        tell(f"{name}: {time.perf_counter() - start:.3f} s")
