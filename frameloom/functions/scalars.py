"""Durations, regions, file names and guarded shares as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, Region


def in_region(r: Region, x: Column, y: Column) -> Column:
    """True strictly inside; a null or NaN coordinate is outside."""
    return F.coalesce((x > F.lit(r.xmin)) & (x < F.lit(r.xmax)) & (y > F.lit(r.ymin)) & (y < F.lit(r.ymax)), F.lit(False))


def seconds(frames: Column, c: Config = DEFAULT) -> Column:
    return frames / F.lit(float(c.db_fps))


def hms(secs: Column) -> Column:
    """HH:MM:SS, truncated, hours without bound."""
    s = F.floor(secs).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def hours(secs: Column) -> Column:
    return secs / F.lit(3600.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole != 0, part / F.when(whole != 0, whole)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(100.0) * part / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


def start_frame(name: Column) -> Column:
    """The frame number at the end of a file name, before its extension; null if there is none."""
    # Fixed value: how recordings name their files.
    found = F.regexp_extract(name, r"t(\d+)\.[A-Za-z0-9]+$", 1)
    return F.when(found != "", found).cast("long")


def local_frame(frame: Column, start: Column, count: Column, c: Config = DEFAULT) -> Column:
    """A frame's index in its video: half goes to even, clamped to the video."""
    return F.greatest(F.lit(0), F.least(F.bround((frame - start) / F.lit(float(c.frame_conversion))).cast("long"), count - 1))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
