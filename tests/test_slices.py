"""Order-dependent operators over slices of an animal's frames, against plain versions over whole animals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.config import Config
from frameloom.operators import selection, slices, trajectory

PLACE = "ANIMALID long, FRAMENUMBER long, MASS_X double, MASS_Y double"


def places(seed, animals=3, frames=160, there=0.8):
    """Sparse frames, from negative ones on, whole slices missing, long runs without a move, and some missing coordinates."""
    rng = random.Random(seed)
    rows = []
    for a in range(animals):
        x, hole = 0.0, range(50 + 7 * a, 75 + 9 * a)
        for f in range(-13, frames):
            x += rng.choice((0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 30.0)) if f < 100 else 0.0
            if f not in hole and (rng.random() < there or 100 <= f < 140):
                rows.append((a, f, None if rng.random() < 0.02 else x, float(f % 3 == 0)))
    return [*rows, (7, 5, 1.0, 1.0), (8, 1, 0.0, 0.0), (8, 40, 0.0, 0.0)]


def by_animal(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(r[0], []).append(r)
    return out


def gap(p, q):
    return math.nan if None in (p[2], q[2]) else math.sqrt((q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2)


def plain_bouts(rows, least, pairs):
    out = []
    for a, own in by_animal(rows).items():
        start = n = 0
        for p, q in zip(own, [*own[1:], None], strict=True):
            if q is not None and q[1] - p[1] == 1 and gap(p, q) < least:
                start, n = (start, n + 1) if n else (p[1], 1)
                continue
            if n >= pairs:
                out.append((a, start, n))
            n = 0
    return sorted(out)


def plain_velocities(rows, fps):
    out = []
    for a, own in by_animal(rows).items():
        number = 0
        for k, (p, q) in enumerate(zip(own, own[1:])):
            if q[1] - p[1] < 2:
                continue
            number += 1
            before = gap(own[k - 1], p) * fps if k and p[1] - own[k - 1][1] == 1 else None
            after = gap(q, own[k + 2]) * fps if k + 2 < len(own) and own[k + 2][1] - q[1] == 1 else None
            near = lambda v: None if v is None or math.isnan(v) else round(v, 6)
            out.append((a, p[1], q[1], number, near(before), near(after)))
    return sorted(out)


@pytest.mark.parametrize("slice_frames", [2, 10, 1 << 20])
def test_bouts_in_slices(spark, slice_frames):
    rows, c = places(slice_frames), Config(stationary_distance=5.0, stationary_pairs=3)
    got = trajectory.bouts(spark.createDataFrame(rows, PLACE).repartition(3), c, slice_frames)
    assert sorted((r["ANIMALID"], r["start_frame"], r["pairs"]) for r in got.collect()) == plain_bouts(rows, 5.0, 3)


@pytest.mark.parametrize("slice_frames", [1, 10, 1 << 20])
def test_velocities_in_slices(spark, slice_frames):
    rows = places(slice_frames + 100)
    got = trajectory.velocity_gaps(spark.createDataFrame(rows, PLACE).repartition(3), Config(), slice_frames).collect()
    near = lambda v: None if v is None else round(v, 6)
    assert sorted((r["ANIMALID"], r["start_frame"], r["end_frame"], r["gap_index"], near(r["velocity_before_px_per_sec"]), near(r["velocity_after_px_per_sec"])) for r in got) == plain_velocities(rows, 30)


@pytest.mark.parametrize(("before", "after"), [(1, 1), (3, 1), (1, 3)])
def test_neighbours_of_small_slices(spark, before, after):
    rows = places(9)
    got = slices.neighbours(spark.createDataFrame(rows, PLACE), [], before, after, 2).collect()
    own = {a: [r[1] for r in v] for a, v in by_animal(rows).items()}
    for r in got:
        f, k = own[r["ANIMALID"]], own[r["ANIMALID"]].index(r["FRAMENUMBER"])
        frames = lambda side, n: [None if x is None else x["FRAMENUMBER"] for x in (r[f"{side}_{i}"] for i in range(1, n + 1))]  # noqa: B023, E731
        assert frames("prev", before) == [f[k - i] if k - i >= 0 else None for i in range(1, before + 1)]
        assert frames("next", after) == [f[k + i] if k + i < len(f) else None for i in range(1, after + 1)]


def test_no_task_holds_more_than_a_slice(spark):
    """One animal with all rows is dealt to as many groups as slices hold rows."""
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("ANIMALID"), F.col("id").alias("FRAMENUMBER"), F.lit(0.0).alias("MASS_X"), F.lit(0.0).alias("MASS_Y"))
    for df in (trajectory.bouts(rows, Config(), 100), trajectory.velocity_gaps(rows, Config(), 100)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        # Windows over an animal run along the table of slices, whose rows aggregates have made.
        assert windows and all("_slice" in w for w in windows)
    assert [(r["start_frame"], r["pairs"]) for r in trajectory.bouts(rows, Config(), 100).collect()] == [(0, 3999)]


@pytest.mark.parametrize("digit", [8, 12])
def test_percentiles(spark, digit):
    rng = np.random.default_rng(digit)
    groups = {"a": [5], "b": [], "c": rng.integers(-50, 50, 40).tolist(), "d": rng.integers(0, 1 << 40, 301).tolist(), None: [7, 7, 7, 8], "e": [-(1 << 62), 1 << 62, 0, -1], "f": [-1, -1]}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    shares = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p100": 1.0}
    got = {r["k"]: tuple(r[p] for p in shares) for r in selection.percentiles(df, "v", shares, ("k",), digit).collect()}
    assert got.keys() == {k for k, v in groups.items() if v}
    for k, found in got.items():
        assert np.allclose(found, np.quantile(np.array(groups[k], float), list(shares.values())), rtol=1e-12), k
    every = selection.percentiles(df, "v", shares, (), digit).collect()
    assert np.allclose(tuple(every[0]), np.quantile(np.array([v for vs in groups.values() for v in vs], float), list(shares.values())), rtol=1e-12)
    assert selection.percentiles(df.limit(0), "v", shares, ("k",)).count() == 0


def test_distribution_of_nothing(spark):
    none = spark.createDataFrame([], "ANIMALID long, pairs long")
    assert [tuple(r) for r in trajectory.distribution(none, "pairs").collect()] == [(0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert trajectory.suggested_minutes(trajectory.distribution(none, "pairs")).first()[0] == 30
    assert trajectory.distribution(none, "pairs", by=("ANIMALID",)).count() == 0


def test_row_numbers(spark):
    rows = places(3)
    got = slices.row_numbers(spark.createDataFrame(rows, PLACE), "FRAMENUMBER", "n", 10).collect()
    assert all(r["n"] == [x[1] for x in by_animal(rows)[r["ANIMALID"]]].index(r["FRAMENUMBER"]) + 1 for r in got)
