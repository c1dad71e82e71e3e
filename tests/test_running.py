"""Frames of ranges told by running sums, against every frame; ranges too long for a row per frame."""

from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from __spark_entry__ import queries
from frameloom.operators import gaps, running
from frameloom.sources import events as ev

RANGES = "ANIMALID long, first_frame long, last_frame long, IN_NEST int"


def test_sums_over_ranges(spark):
    rows = [(a, lo, lo + n, (lo + n) % 2) for a in (0, 3, 131, None) for lo in (-20, -1, 0, 6, 7, 127, 1000) for n in (0, 1, 6, 7, 8, 140, 300)] + [(1, None, 3, 1), (1, 3, 2, 1)]
    ranges = spark.createDataFrame(rows, RANGES)
    got = running.over_frames(ranges, {"v": lambda k, f: f * f % 7 + F.coalesce(k, F.lit(9))}, 7, F.pmod("ANIMALID", F.lit(5)), 5).collect()
    own = lambda a, f: f * f % 7 + (9 if a is None else a % 5)
    want = [(*r, sum(own(r[0], f) for f in range(r[1], r[2] + 1))) for r in rows[:-2]]
    assert Counter(map(tuple, got)) == Counter(want)
    labels = gaps.frames(ranges.filter("first_frame <= last_frame")).withColumn("MANUAL_QC", ev.labeller(F.col("ANIMALID"), F.col("FRAMENUMBER"), F.col("IN_NEST")))
    by_frame = labels.filter("MANUAL_QC is not null").groupBy("ANIMALID", "IN_NEST", "MANUAL_QC").count()
    by_range = ev.labelled_ranges(ranges).groupBy("ANIMALID", "IN_NEST", "MANUAL_QC").agg(F.sum("n"))
    assert sorted(map(str, map(tuple, by_frame.collect()))) == sorted(map(str, map(tuple, by_range.collect())))


def test_a_gap_of_more_frames_than_an_array_holds(spark, tmp_path):
    last = datetime(8000, 1, 1)
    table = {"event_id": [0, 1], "ts": pa.array([datetime(2024, 1, 1), last], pa.timestamp("us")), "user_id": [4, 4], "event_type": ["view", "view"], "value": [20.0, 20.0], "props": ['{"k": 30}'] * 2}
    pq.write_table(pa.table(table), tmp_path / "events.parquet")
    n = (last - datetime(2024, 1, 1)).days * 1440 - 1
    p = 1_000_003
    squares = np.arange(p) ** 2 % p
    want = (n, n * (n + 1) // 2, n // p * int(squares.sum()) + int(squares[: n % p + 1].sum()))
    for name in ("q_gap_fill_frames", "q_review_frames"):
        (row,) = [r for r in queries()[name](spark, str(tmp_path)).collect() if r["n"] > 2]
        assert (row["n"], row["frame_sum"], row["square_sum"]) == want
    labels = Counter(None if (f * 5 + 4) % 13 == 0 else (f * 3 + 4) % 10 == 0 for f in range(130))
    rest = Counter(None if (f * 5 + 4) % 13 == 0 else (f * 3 + 4) % 10 == 0 for f in range(1, n % 130 + 1))
    (row,) = [r for r in queries()["q_confusion_by_mode"](spark, str(tmp_path)).collect() if r["qc_mode"] == "LOGIC"]
    assert (row["TP"], row["FP"]) == tuple(n // 130 * labels[k] + rest[k] for k in (False, True))
