"""Stationary bouts, velocities around gaps, percentiles, histograms and frame-range cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import distance, seconds, share
from .gaps import pairs
from .selection import percentiles
from .slices import SLICE, neighbours, row_numbers, runs


def bouts(detections: DataFrame, c: Config = DEFAULT, slice_frames: int = SLICE) -> DataFrame:
    """Runs of successive frames with less than a distance between them: pairs and seconds; short runs are left out.

    A pair that moves, or whose frames are not successive, ends a run. Runs are
    summed up within slices of an animal's frames and joined where they go on in the next one.
    """
    p = pairs(detections, ["MASS_X", "MASS_Y"], slice_frames)
    still = (F.col("next_FRAMENUMBER") - F.col("FRAMENUMBER") == 1) & (distance(F.col("MASS_X"), F.col("MASS_Y"), F.col("next_MASS_X"), F.col("next_MASS_Y")) < c.stationary_distance)
    return runs(p, still, slice_frames).filter(F.col("pairs") >= c.stationary_pairs).select("ANIMALID", "start_frame", "pairs", seconds(F.col("pairs"), c).alias("duration_sec"))


def velocity_gaps(detections: DataFrame, c: Config = DEFAULT, slice_frames: int = SLICE) -> DataFrame:
    """Gaps with the speed just before and after; null where the neighbouring frame is missing too. Not rounded.

    A gap needs one row before and two after its first frame, which slices tell each other.
    """
    s = neighbours(detections.select("ANIMALID", "FRAMENUMBER", "MASS_X", "MASS_Y"), ["MASS_X", "MASS_Y"], 1, 2, slice_frames)
    frame = F.lit(1.0) / F.lit(float(c.db_fps))
    speed = lambda a, b: distance(a["MASS_X"], a["MASS_Y"], b["MASS_X"], b["MASS_Y"]) / frame
    here, prev, one, two = F.struct("MASS_X", "MASS_Y"), F.col("prev_1"), F.col("next_1"), F.col("next_2")
    before = F.when(F.col("FRAMENUMBER") - prev["FRAMENUMBER"] == 1, speed(prev, here))
    after = F.when(two["FRAMENUMBER"] - one["FRAMENUMBER"] == 1, speed(one, two))
    size = one["FRAMENUMBER"] - F.col("FRAMENUMBER") - 1
    g = s.filter(size > 0).select("ANIMALID", F.col("FRAMENUMBER").alias("start_frame"), one["FRAMENUMBER"].alias("end_frame"), size.alias("gap_length_frames"), seconds(size, c).alias("gap_duration_sec"), before.alias("velocity_before_px_per_sec"), after.alias("velocity_after_px_per_sec"))
    return row_numbers(g, "start_frame", "gap_index", slice_frames)


def distribution(rows: DataFrame, frames: str, c: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, max and the exact quartiles (interpolated) in seconds of a column of frames, for each group of `by`; zeros for no rows.

    Sums are of whole numbers, so the mean does not depend on the order of rows.
    """
    d = rows.groupBy(*by).agg(F.count(frames).alias("n"), F.sum(frames).alias("_sum"), F.max(frames).alias("max"))
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    q = percentiles(rows, frames, shares, by)
    met = d.join(q, list(by), "left") if by else d.join(F.broadcast(q), how="left", on=F.lit(True))
    zero = lambda x: F.coalesce(seconds(x, c), F.lit(0.0))
    return met.select(*by, "n", zero(share(F.col("_sum"), F.col("n"))).alias("mean"), zero(F.col("max")).alias("max"), *[zero(F.col(p)).alias(p) for p in shares])


def suggested_minutes(d: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A stationary threshold: the upper quartile rounded up to five minutes, from 5 to 60; 30 without bouts."""
    up = (F.ceil(F.col("p75") / 60.0 / 5.0) * 5).cast("long")
    return d.select(*by, F.when(F.col("n") == 0, F.lit(30)).otherwise(F.greatest(F.lit(5), F.least(F.lit(60), up))).cast("long").alias("suggested_minutes"))


def histogram(rows: DataFrame, column: str, beyond: float, by: tuple[str, ...] = ()) -> DataFrame:
    """bin and count of equal bins from 0 to the maximum plus `beyond`, for each group of `by`: half as many bins as rows, from 10 to 60.

    Equal values are counted before they meet their group's limits, so no group is moved row by row.
    """
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("_n"))
    limits = counts.groupBy(*by).agg(F.max(column).alias("_max"), F.least(F.lit(60), F.greatest(F.lit(10), F.floor(F.sum("_n") / 2))).alias("_bins"))
    met = counts.join(limits, list(by)) if by else counts.join(F.broadcast(limits), how="cross")
    bins = met.withColumn("bin", F.least(F.floor(F.col(column) * F.col("_bins") / (F.col("_max") + beyond)), F.col("_bins") - 1).cast("long"))
    return bins.groupBy(*by, "bin").agg(F.sum("_n").alias("n"))


def overview(detections: DataFrame, c: Config = DEFAULT) -> DataFrame:
    first, last = F.min("FRAMENUMBER"), F.max("FRAMENUMBER")
    return detections.groupBy("ANIMALID").agg(F.count("*").alias("n"), first.alias("first_frame"), last.alias("last_frame"), seconds(last - first, c).alias("duration_sec"))


def normalised(detections: DataFrame) -> DataFrame:
    """Each frame's place in its animal's recording, from 0 to 1."""
    ends = detections.groupBy("ANIMALID").agg(F.min("FRAMENUMBER").alias("_lo"), F.max("FRAMENUMBER").alias("_hi"))
    return detections.join(ends, "ANIMALID").select("ANIMALID", "FRAMENUMBER", ((F.col("FRAMENUMBER") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)).cast("double")).alias("t"))


def cut(tables: dict[str, DataFrame], first: int, last: int) -> dict[str, DataFrame]:
    """Every table's rows from one frame to another, both included; tables without frames stay whole."""
    if int(first) > int(last):
        raise ValueError("the first frame is after the last")
    in_range: Column = F.col("FRAMENUMBER").between(int(first), int(last))
    return {k: t.filter(in_range) if "FRAMENUMBER" in t.columns else t for k, t in tables.items()}
