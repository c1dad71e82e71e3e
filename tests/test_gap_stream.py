"""The streaming gap detector: arrivals in any order within the watermark give the batch's gaps."""

import random
from datetime import datetime, timedelta

from frameloom.operators import dedup, gaps
from frameloom.streaming import gap_stream

RAW = "_rowid long, ANIMALID long, FRAMENUMBER long, MASS_X double, MASS_Y double, ts timestamp"
START = datetime(2024, 1, 1)


def at(frame):
    return START + timedelta(minutes=frame)


def arrivals(seed, frames=400, late=60):
    """Detections in batches, each up to `late` frames out of order, with copies and frames that disagree."""
    rng = random.Random(seed)
    rows = []
    for a in (1, 2, 3):
        f = rng.randint(0, 5)
        while f < frames:
            x, y = rng.choice((30.0, 70.0, 200.0)), 50.0
            rows.append((a, f, x, y))
            if rng.random() < 0.1:
                rows.append((a, f, x if rng.random() < 0.5 else x + 1, y))
            f += rng.choice((1, 1, 1, 2, 5, 30))
    rows.sort(key=lambda r: r[1] + rng.uniform(0, late))
    return [(k, *r, at(r[1])) for k, r in enumerate(rows)]


def run(spark, tmp_path, batches, lateness):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(source)
    stream = gap_stream.changes(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source), "ts", lateness)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    return spark.read.parquet(out), dropped


def keyed(df):
    return sorted(map(repr, (tuple(r) for r in df.select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "size", "gap_type", "fill", "route").collect())))


def batch(spark, rows):
    return gaps.gaps(gaps.classify(dedup.dedup(spark.createDataFrame(rows, RAW).drop("ts"))))


def test_shuffled_arrival_within_the_watermark(spark, tmp_path):
    rows = arrivals(3)
    n = len(rows) // 4
    told, dropped = run(spark, tmp_path, [rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n], rows[3 * n :]], "3 hours")
    assert dropped == 0
    assert keyed(gap_stream.current(told)) == keyed(batch(spark, rows))
    # Gaps were taken back or told anew, and what was final never was.
    assert told.filter("GAP_END_FRAME is null").count() > 0
    final = {(r["ANIMALID"], r["GAP_START_FRAME"]): r["version"] for r in told.filter("final").collect()}
    assert final
    assert not [r for r in told.filter("not final").collect() if r["version"] > final.get((r["ANIMALID"], r["GAP_START_FRAME"]), 1 << 40)]


def test_later_rows_are_counted(spark, tmp_path):
    first = [(k, 1, f, 30.0, 50.0, at(f)) for k, f in enumerate((0, 10, 20, 500))]
    second = [(10, 1, 900, 30.0, 50.0, at(900))]
    third = [(11, 1, 15, 30.0, 50.0, at(15)), (12, 1, 890, 30.0, 50.0, at(890))]
    told, dropped = run(spark, tmp_path, [first, second, third], "1 hour")
    assert dropped == 1
    assert keyed(gap_stream.current(told)) == keyed(batch(spark, [*first, *second, third[1]]))


def test_a_table_is_told_at_once(spark):
    rows = arrivals(5)
    assert keyed(gap_stream.current(gap_stream.changes(spark.createDataFrame(rows, RAW).drop("ts"), None))) == keyed(batch(spark, rows))
