"""All constants of the engine, in one object."""

from __future__ import annotations

from dataclasses import dataclass

# Tags that tables carry.
DETECTED, ASSUMED = "DETECTED", "ASSUMED"
LOGIC, BINARY_SEARCH, UNKNOWN = "LOGIC", "BINARY_SEARCH", "UNKNOWN"
GAP_TYPES = ("00", "01", "10", "11")


@dataclass(frozen=True)
class Region:
    """An open rectangle."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float


@dataclass(frozen=True)
class Config:
    """Frame rates, thresholds (in frames, all inclusive) and regions."""

    db_fps: int = 30
    frame_conversion: int = 2  # database frames per video frame
    video_fps: float = 15.0
    fps_tolerance: float = 0.5
    short_gap: int = 900  # gaps of so many missing frames are not reviewed
    short_segment: int = 1800  # segments that one answer fills
    checkpoint: int = 1800  # frames between checkpoints of a gap between two absences
    stationary_distance: float = 10.0
    stationary_pairs: int = 900
    samples: int = 100
    nest: Region = Region(0.0, 60.0, 10.0, 80.0)
    buffer: Region = Region(-10.0, 90.0, 0.0, 95.0)

    def __post_init__(self) -> None:
        for name, r in (("nest", self.nest), ("buffer", self.buffer)):
            if not (r.xmin < r.xmax and r.ymin < r.ymax):
                raise ValueError(f"{name}: minima must be below maxima")
        if not (self.buffer.xmin <= self.nest.xmin and self.buffer.xmax >= self.nest.xmax and self.buffer.ymin <= self.nest.ymin and self.buffer.ymax >= self.nest.ymax):
            raise ValueError("the buffer must contain the nest")


DEFAULT = Config()
