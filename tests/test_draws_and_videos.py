"""Samples drawn by a permutation, and frames found in overlapping videos, against plain versions."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frameloom.operators import pools, video

VIDEO = "start long, `end` long, path string, frame_count long"
RANGES = "ANIMALID long, first_frame long, last_frame long, IN_NEST int, GAP_START_FRAME long, GAP_END_FRAME long"


def plain_place(i, size, key):
    a = math.ceil(math.sqrt(size))
    b = (size + a - 1) // a
    mix = lambda j, v: int(hashlib.md5(f"{key}|{j}|{v}".encode()).hexdigest()[:15], 16)
    x, first = i, True
    while first or x >= size:
        first = False
        left, right = x % a, x // a
        for j in range(4):
            if j % 2:
                right = (right + mix(j, left)) % b
            else:
                left = (left + mix(j, right)) % a
        x = left + a * right
    return x


def test_the_permutation_is_one(spark):
    rows = [(n, i) for n in [*range(1, 40), 101, 289, 1000] for i in range(n)]
    df = spark.createDataFrame(rows, "n long, i long")
    got = {(r["n"], r["i"]): r["p"] for r in df.select("n", "i", pools.permuted(F.col("i"), F.col("n"), F.concat(F.lit("k"), F.col("n").cast("string"))).alias("p")).collect()}
    for n in {n for n, _ in rows}:
        assert sorted(got[n, i] for i in range(n)) == list(range(n))
        assert [got[n, i] for i in range(n)] == [plain_place(i, n, f"k{n}") for i in range(n)]


@pytest.mark.parametrize("slice_frames", [3, 1 << 20])
def test_places_become_frames(spark, monkeypatch, slice_frames):
    monkeypatch.setattr(pools, "with_slice", lambda df, column: df.withColumn("_slice", F.floor(F.col(column) / slice_frames)))
    rows = [(1, 2, 9, 1, 1, 21), (1, 12, 12, 0, 1, 21), (1, 14, 20, 1, 1, 21), (2, 5, 6, 0, 4, 7), (1, 31, 31, 1, None, None), (1, 40, 41, 1, None, None), (None, 3, 8, 1, 2, 9)]
    pool = spark.createDataFrame(rows, RANGES)
    want = []
    for r in pools.allocation(pool, 15).collect():
        key = "|".join(["9", *("null" if r[c] is None else str(r[c]) for c in ("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME"))])
        own = [f for x in sorted(rows, key=lambda x: x[1]) if (x[0], x[4], x[5]) == (r["ANIMALID"], r["GAP_START_FRAME"], r["GAP_END_FRAME"]) for f in range(x[1], x[2] + 1)]
        want += [(r["ANIMALID"], own[plain_place(i, len(own), key)]) for i in range(r["allocated"])]
    drawn = pools.sample(pool, 15, 9)
    assert Counter((r["ANIMALID"], r["FRAMENUMBER"]) for r in drawn.collect()) == Counter(want) and len(want) == len(set(want)) == 15
    by_frame = pool.withColumn("FRAMENUMBER", F.explode(F.sequence("first_frame", "last_frame"))).drop("first_frame", "last_frame")
    assert Counter((r["ANIMALID"], r["FRAMENUMBER"]) for r in pools.sample(by_frame, 15, 9).collect()) == Counter(want)


def test_a_sample_evaluates_its_pool_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    pool = spark.createDataFrame([(k, 10, 19, 1, 9, 20) for k in range(50)], RANGES)
    pool = pool.withColumn("first_frame", counted.asNondeterministic()("first_frame"))
    assert pools.sample(pool, 20, 1).count() == 20
    assert seen.value == 50


def plain_candidates(frame, videos):
    """Least start among the videos that cover a frame; else the last end before and the first start after, the nearer first."""
    own = sorted(videos, key=lambda v: (v[0], v[2]))
    for v in own:
        if v[0] <= frame < v[1]:
            return [(frame, v[2])]
    back = min((v for v in own if v[1] <= frame), key=lambda v: (-v[1], v[0], v[2]), default=None)
    ahead = min((v for v in own if v[0] > frame), key=lambda v: (v[0], v[2]), default=None)
    out = ([(back[1] - 2, back[2])] if back else []) + ([(ahead[0], ahead[2])] if ahead else [])
    return out[::-1] if back and ahead and frame - out[0][0] > out[1][0] - frame else out


@pytest.mark.parametrize(("seed", "tile", "wide"), [(1, 7, 5), (2, 64, 1 << 20), (3, 1 << 12, 16)])
def test_overlapping_and_nested_videos(spark, monkeypatch, seed, tile, wide):
    monkeypatch.setattr(video, "PART_ROWS", 40)
    rng = random.Random(seed)
    videos = []
    for k in range(40):
        start, n = rng.randrange(-50, 900), rng.choice((1, 2, 5, 20, 60))
        videos.append((start, start + 2 * n, f"v{k:02d}", n))
    videos += [(*videos[0][:2], "copy", videos[0][3]), (videos[1][0], videos[1][0], "empty", 0)]
    frames = [(a, f) for a in (1, 2, 3) for f in range(-80, 1000, a)]
    files = spark.createDataFrame(videos, VIDEO)
    monkeypatch.setattr(video.shown_ranges, "__defaults__", (wide,))
    got = {}
    for r in video.candidates(spark.createDataFrame(frames, "ANIMALID long, FRAMENUMBER long"), files, slice_frames=tile).collect():
        got.setdefault((r["ANIMALID"], r["FRAMENUMBER"]), {})[r["candidate_rank"]] = (r["resolved"], r["path"])
    for a, f in frames:
        assert [got[a, f][k] for k in sorted(got[a, f])] == plain_candidates(f, videos), f
    bad = spark.createDataFrame([(v[2],) for v in videos[::3]], "path string")
    found = {r["FRAMENUMBER"]: r["video"] for r in video.resolved(spark.createDataFrame([(1, f) for f in range(0, 900, 5)], "ANIMALID long, FRAMENUMBER long"), files, bad).collect()}
    for f in range(0, 900, 5):
        assert found.get(f) == next((p for _, p in plain_candidates(f, videos) if p not in {v[2] for v in videos[::3]}), None)


def test_of_videos_that_share_a_path_only_the_unreadable_one_goes(spark):
    videos = spark.createDataFrame([(10, 20, "t10.mp4", 5), (10, 18, "t10.mp4", 4), (30, 34, "t30.mp4", 2)], VIDEO)
    frames = spark.createDataFrame([(1, 12), (1, 19), (1, 31)], "ANIMALID long, FRAMENUMBER long")
    bad = spark.createDataFrame([("t10.mp4", 5)], "path string, frame_count long")
    found = {r["FRAMENUMBER"]: (r["video"], r["local_frame"]) for r in video.resolved(frames, videos, bad).collect()}
    assert found == {12: ("t10.mp4", 1), 31: ("t30.mp4", 0)}
    by_path = {r["FRAMENUMBER"] for r in video.resolved(frames, videos, bad.select("path")).collect()}
    assert by_path == {31}
