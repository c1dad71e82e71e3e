"""Literal cases of each operator."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from frameloom.cli import main
from frameloom.config import ASSUMED, BINARY_SEARCH, DETECTED, LOGIC, Config, Region
from frameloom.operators import dedup, gaps, metrics, pools, review, trajectory, video
from frameloom.plans import report
from frameloom.sources import metadata, sqlite
from frameloom.streaming import answers as log

SMALL = Config(nest=Region(0, 10, 0, 10), buffer=Region(-5, 15, -5, 15))
DET = "_rowid long, FRAMENUMBER long, ANIMALID long, MASS_X double, MASS_Y double"
FRAMES = "ANIMALID long, FRAMENUMBER long, MASS_X double, MASS_Y double"


def detections(spark, rows, schema=DET):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], schema)


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([(1, 1, 100.0, 200.0), *[(2, 1, 101.0, 201.0)] * 3], [1, 2]),
        ([(1, 1, 100.0, 200.0), (2, 1, 101.0, 201.0), (2, 1, 999.0, 999.0)], [1]),
        ([(5, 1, 100.0, 200.0), (5, 2, 300.0, 400.0)], [1, 2]),
        ([(1, 1, float("nan"), None), (1, 1, float("nan"), None)], [1]),
        ([(None, 1, 1.0, 1.0), (None, 1, 1.0, 1.0), (1, None, 2.0, 2.0)], [1, 2, 3]),
        ([], []),
    ],
)
def test_dedup(spark, rows, kept):
    once = dedup.dedup(detections(spark, rows))
    assert sorted(r["_rowid"] for r in once.collect()) == kept
    assert sorted(r["_rowid"] for r in dedup.dedup(once).collect()) == kept
    s = dedup.stats(detections(spark, rows)).first()
    assert s["rows_after"] == len(kept)


def test_dedup_ignores_surrogate_keys(spark):
    raw = detections(spark, [(1, 1, 100.0, 200.0)] * 2).withColumn("ID", F.col("_rowid"))
    assert dedup.dedup(raw).count() == 0
    assert dedup.dedup(raw, ignore=("ID",)).count() == 1


def fill(spark, rows):
    c = gaps.classify(spark.createDataFrame([(1, *r) for r in rows], FRAMES), SMALL)
    return {r["FRAMENUMBER"]: r["IN_NEST"] for r in gaps.timeline(c, gaps.gaps(c, SMALL)).filter("ASSUMPTION_TYPE = 'ASSUMED'").collect()}


def test_fill_rule(spark):
    assert fill(spark, [(1, 5.0, 5.0), (5, 5.0, 5.0)]) == {2: 1, 3: 1, 4: 1}
    assert fill(spark, [(1, 5.0, 5.0), (5, 100.0, 100.0)]) == {2: -1, 3: -1, 4: -1}
    assert fill(spark, [(1, 5.0, 5.0), (5, 12.0, 12.0)]) == {2: 1, 3: 1, 4: 1}  # in the buffer, typed 10, yet filled
    assert fill(spark, [(1, 12.0, 5.0), (3, 5.0, 5.0)]) == {2: -1}
    assert fill(spark, [(1, 5.0, 5.0), (2, 5.0, 5.0), (3, 5.0, 5.0)]) == {}
    assert fill(spark, [(1, 10.0, 5.0), (3, 5.0, 5.0)]) == {2: -1}  # borders are outside
    assert fill(spark, [(1, None, 5.0), (3, float("nan"), 5.0)]) == {2: -1}


def test_regions_are_checked():
    with pytest.raises(ValueError, match="minima"):
        Config(nest=Region(5, 5, 0, 1))
    with pytest.raises(ValueError, match="contain"):
        Config(nest=Region(0, 100, 0, 10), buffer=Region(0, 50, 0, 10))
    Config(nest=Region(0, 10, 0, 10), buffer=Region(0, 10, 0, 10))


def test_guard(spark):
    good = spark.createDataFrame([(1, k, 5.0, 5.0) for k in (1, 2, 4)], FRAMES)
    assert gaps.require_increasing(good).count() == 3
    with pytest.raises(ValueError, match="duplicate or non-increasing"):
        gaps.require_increasing(spark.createDataFrame([(1, k, 5.0, 5.0) for k in (1, 2, 2, 3)], FRAMES))
    with pytest.raises(ValueError, match="without a frame"):
        gaps.require_increasing(spark.createDataFrame([(1, None, 5.0, 5.0)], FRAMES))


def test_pairs_across_slices(spark):
    frames = [0, 3, 4, 9, 25, 26, 61]
    rows = spark.createDataFrame([(a, f, 0.0, 0.0) for a in (1, 2) for f in frames], FRAMES)
    for width in (1, 5, 10, 1000):
        got = sorted((r["ANIMALID"], r["FRAMENUMBER"], r["next_FRAMENUMBER"]) for r in gaps.pairs(rows, [], width).collect())
        assert got == [(a, x, y) for a in (1, 2) for x, y in zip(frames, frames[1:])]


def test_gap_types(spark):
    states = spark.createDataFrame([(1, 100, 1), (1, 200, 0), (1, 300, 1), (1, 400, 0), (1, 500, 7)], "ANIMALID long, FRAMENUMBER long, IN_NEST int")
    asked = spark.createDataFrame([(1, 200, 400), (1, 200, 300), (1, 100, 200), (1, 100, 300), (1, 100, 999), (1, 400, 500)], "ANIMALID long, GAP_START_FRAME long, GAP_END_FRAME long")
    g = gaps.with_boundaries(asked, states)
    got = {(r["GAP_START_FRAME"], r["GAP_END_FRAME"]): r["gap_type"] for r in g.collect()}
    assert got == {(200, 400): "00", (200, 300): "01", (100, 200): "10", (100, 300): "11", (100, 999): None, (400, 500): None}
    with pytest.raises(ValueError, match="without a type"):
        gaps.require_types(g)


GAP = "ANIMALID long, GAP_START_FRAME long, GAP_END_FRAME long, size long, gap_type string, fill int"


def open_gaps(spark, rows, c=Config()):
    return spark.createDataFrame([(1, a, b, b - a - 1, t, -1) for a, b, t in rows], GAP).withColumn("route", gaps.route(c))


def test_routes(spark):
    rows = [(100, 200, "00"), (1000, 1030, "10"), (1000, 1930, "10"), (0, 901, "01"), (0, 902, "01"), (0, 5000, "11"), (0, 5000, "00")]
    got = [r["route"] for r in open_gaps(spark, rows).collect()]
    assert got == ["short_00", "short", "bisect", "short", "bisect", "type_11", "checkpoints"]


def test_checkpoints(spark):
    g = open_gaps(spark, [(1000, 6552, "00"), (10000, 11051, "00"), (20000, 20600, "00")])
    got = sorted((r["seg_start"], r["seg_end"]) for r in gaps.checkpoints(g).collect())
    assert got == [(1001, 2800), (2801, 4600), (4601, 6400), (6401, 6551), (10001, 11050)]


def scripted(spark, gap, script):
    """Segments of one gap; `script` maps shown frames to answers."""
    g = open_gaps(spark, [gap]).withColumn("answers", F.create_map(*[F.lit(x).cast("long") for kv in script.items() for x in kv]))
    answer = lambda m: F.element_at(F.col("answers"), m)
    segs = [(r["seg_start"], r["seg_end"], r["value"]) for r in review.segments(g, answer).collect()]
    waits = [r["show_frame"] for r in review.unresolved(g, answer).collect()]
    return segs, waits


def test_review_scripts(spark):
    gap = (1000, 6552, "00")
    assert scripted(spark, gap, {2800: 1}) == ([(1001, 2800, 1)], [(2801 + 6551) // 2])
    assert scripted(spark, gap, {2800: 0, 4600: 0, 6400: 1, 6476: 0}) == ([(1001, 2800, 0), (2801, 4600, 0), (4601, 6400, 1), (6401, 6551, 0)], [])
    assert scripted(spark, gap, {2800: 0, 4600: 0, 6400: 0, 6551: 1}) == ([(1001, 2800, 0), (2801, 4600, 0), (4601, 6400, 0), (6401, 6551, 1)], [])
    assert scripted(spark, gap, {2800: 0, 4600: -1, 6400: 0}) == ([(1001, 2800, 0), (2801, 4600, -1), (4601, 6400, 0)], [6551])
    assert scripted(spark, gap, {2800: 1, 4676: -1}) == ([(1001, 2800, 1), (2801, 6551, -1)], [])
    assert scripted(spark, (5050, 6401, "10"), {5725: 1}) == ([(5051, 6400, 1)], [])
    assert scripted(spark, (1000, 1930, "10"), {1: 1}) == ([], [1465])


def simulate(gap, answer):
    """The review as a stack of tasks, frame by frame."""
    gs, ge, t = gap
    out = {}
    if t == "00":
        ends = list(range(gs + 1800, ge - 1, 1800)) + [ge - 1]
        tasks = [("00", a, b) for a, b in zip([gs + 1, *[x + 1 for x in ends[:-1]]], ends)]
    else:
        tasks = [(t, gs + 1, ge - 1)]
    while tasks:
        t, s, e = tasks.pop(0)
        m = e if t == "00" else (s + e) // 2
        a = answer(m)
        lo, hi, then = s, e, None
        if a == -1:
            pass
        elif t == "00":
            if a == 1:
                tasks, then = [], ("10", e + 1, ge - 1)
        elif e - s + 1 > 1800:
            if (t, a) in (("10", 1), ("01", 0)):
                hi, then = m, (t, m + 1, e)
            else:
                lo, then = m, (t, s, m - 1)
        out.update(dict.fromkeys(range(lo, hi + 1), a))
        if then and then[1] <= then[2]:
            tasks.insert(0, then)
    return out


def test_review_against_simulation(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for _ in range(60):
        size = rng.choice([901, 1800, 1801, 3600, 3601, rng.randint(901, 30000)])
        rows.append((at, at + size + 1, rng.choice(["00", "01", "10"])))
        at += size + 10
    from frameloom.sources.events import reviewer

    got = {}
    for r in review.segments(open_gaps(spark, rows), lambda m: reviewer(F.col("ANIMALID"), m)).collect():
        own = got.setdefault(r["GAP_START_FRAME"], {})
        new = range(r["seg_start"], r["seg_end"] + 1)
        assert not own.keys() & set(new)
        own.update(dict.fromkeys(new, r["value"]))
    for gap in rows:
        assert got[gap[0]] == simulate(gap, lambda f: -1 if (f * 11 + 1) % 97 == 0 else int((f * 7 + 13) % 100 < 45)), gap


def test_checks_raise(spark):
    bad = spark.createDataFrame([("x", 1, 2, False)], "label string, expected long, actual long, ok boolean")
    with pytest.raises(ValueError, match="expected 1, got 2"):
        report.require(bad)


TIMELINE = "ANIMALID long, FRAMENUMBER long, IN_NEST int, ASSUMPTION_TYPE string, GAP_START_FRAME long, GAP_END_FRAME long, FILL_SOURCE string"


def timeline(spark, sizes=(5, 3, 2)):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows += [(1, at + j, j % 2, ASSUMED, at - 1, at + n, (BINARY_SEARCH, LOGIC)[k % 2]) for j in range(n)]
        at += n + 1
    return spark.createDataFrame([*rows, (1, 900, 1, DETECTED, None, None, DETECTED), (1, 901, -1, ASSUMED, 900, 902, "UNKNOWN")], TIMELINE)


def test_pools(spark):
    t = timeline(spark)
    n = lambda df, mode: pools.pool(df, mode).count()
    assert [n(t, m) for m in pools.MODES] == [1, 7, 3, 10]
    flag = t.withColumn("BINARY_SEARCH", (F.col("FILL_SOURCE") == BINARY_SEARCH).cast("int"))
    assert [n(flag.drop("FILL_SOURCE"), m) for m in pools.MODES] == [1, 7, 3, 10]
    assert [n(flag.withColumn("FILL_SOURCE", F.lit(None).cast("string")), m) for m in pools.MODES] == [1, 7, 3, 10]
    bare = t.drop("FILL_SOURCE")
    assert n(bare, LOGIC) == 10
    with pytest.raises(ValueError, match="reviewed"):
        pools.pool(bare, BINARY_SEARCH)
    with pytest.raises(ValueError, match="unknown mode"):
        pools.pool(t, "OTHER")
    assert pools.mode_of(spark.createDataFrame([(" logic ",)], "QC_MODE string")) == LOGIC
    assert pools.mode_of(spark.createDataFrame([("x",)], "QC_MODE string")) == ASSUMED
    assert pools.mode_of(bare) == ASSUMED


def test_samples(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        t = pools.pool(timeline(spark, sizes), ASSUMED)
        n = rng.randint(1, sum(sizes))
        given = pools.allocation(t, n).collect()
        assert sum(r["allocated"] for r in given) == n
        assert all(0 <= r["allocated"] <= r["size"] for r in given)
        one, two = (sorted(map(tuple, pools.sample(t, n, 7).collect())) for _ in range(2))
        assert len(set(one)) == n
        assert one == two
    with pytest.raises(ValueError, match="samples from"):
        pools.sample(t, sum(sizes) + 1)
    with pytest.raises(ValueError, match="empty"):
        pools.sample(t.limit(0), 1)


VIDEO = "start long, `end` long, path string, frame_count long"


def test_video(spark):
    frames = lambda *f: spark.createDataFrame([(1, x) for x in f], "ANIMALID long, FRAMENUMBER long")
    got = lambda v, *f: [(r["resolved"], r["path"]) for r in video.candidates(frames(*f), spark.createDataFrame(v, VIDEO)).orderBy("candidate_rank").collect()]
    assert got([(0, 100, "a", 50), (100, 200, "b", 50)], 50) == [(50, "a")]
    assert got([(0, 102, "a", 51), (104, 200, "b", 48)], 102) == [(100, "a"), (104, "b")]
    assert got([(0, 102, "a", 51), (104, 200, "b", 48)], 103) == [(104, "b"), (100, "a")]
    assert got([(0, 102, "a", 51)], 500) == [(100, "a")]
    assert got([(50, 102, "a", 51)], 5) == [(50, "a")]
    assert got([(0, 100, "a", 50), (50, 200, "b", 75)], 60) == [(60, "a")]
    assert got([], 50) == []
    names = spark.createDataFrame([("/x/cam_t120.mp4", 10, 15.0), ("cam_final.mp4", 1, 15.0), ("t12_cam.mp4", 1, 15.0), ("t5.avi", 1, 12.0), ("t6.avi", 1, 0.0)], "path string, frame_count long, fps double")
    assert sorted((r["start"], r["end"]) for r in video.video_map(names).collect()) == [(5, 7), (6, 8), (120, 140)]
    assert sorted(tuple(r) for r in video.rejects(names).collect()) == [("cam_final.mp4", "unparseable"), ("t12_cam.mp4", "unparseable"), ("t5.avi", "fps mismatch")]
    v = spark.createDataFrame([(0, 102, "a", 51), (104, 200, "b", 48)], VIDEO)
    assert [(r["video"], r["local_frame"]) for r in video.resolved(frames(102, 107), v, spark.createDataFrame([("a",), ("a",), ("z",)], "path string")).orderBy("FRAMENUMBER").collect()] == [("b", 0), ("b", 2)]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (-1, 1), (1, None)], "IN_NEST int, MANUAL_QC int")
    m = metrics.confusion(rows, F.col("IN_NEST"), F.col("MANUAL_QC")).first()
    assert (m["TP"], m["FP"], m["FN"], m["TN"], m["total_labeled"], m["invalid"]) == (1, 1, 1, 2, 5, 1)
    assert (m["accuracy"], m["sensitivity"], m["specificity"]) == (0.6, 0.5, 2 / 3)
    none = metrics.confusion(rows.limit(0), F.col("IN_NEST"), F.col("MANUAL_QC")).first()
    assert none["accuracy"] == none["error_rate"] == none["sensitivity"] == none["specificity"] == 0.0


def test_trajectory(spark):
    rows = [(1, f, float(x), 0.0) for f, x in ((1, 0), (2, 1), (3, 2), (4, 50), (5, 51), (9, 52), (10, 52), (11, 53), (12, 54))]
    d = spark.createDataFrame(rows, FRAMES)
    c = Config(stationary_pairs=2)
    assert sorted((r["start_frame"], r["pairs"]) for r in trajectory.bouts(d, c).collect()) == [(1, 2), (9, 3)]
    v = trajectory.velocity_gaps(d).collect()
    assert [(r["start_frame"], r["gap_length_frames"], round(r["velocity_before_px_per_sec"], 6), r["velocity_after_px_per_sec"]) for r in v] == [(5, 3, 30.0, 0.0)]
    none = trajectory.distribution(trajectory.bouts(d.limit(0)), "pairs")
    assert tuple(none.first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert trajectory.suggested_minutes(none).first()[0] == 30
    with pytest.raises(ValueError, match="after the last"):
        trajectory.cut({}, 5, 4)


def test_metadata(spark, tmp_path):
    path = str(tmp_path / "roi")
    assert not metadata.write(spark, path, 1, None, None)
    assert metadata.read(spark, path) == (None, None)
    assert metadata.write(spark, path, 1, SMALL.nest, None)
    assert metadata.read(spark, path) == (SMALL.nest, None)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE DETECTION (ID INTEGER PRIMARY KEY, FRAMENUMBER INTEGER, ANIMALID INTEGER, MASS_X REAL, MASS_Y REAL, NOTE TEXT)")
        db.executemany("INSERT INTO DETECTION VALUES (?, ?, ?, ?, ?, ?)", [(k, k % 40, k % 2, k / 2, None, f"n{k}") for k in range(1, 101)])
    df = sqlite.read(spark, path, "OTHER, DETECTION", require=("FRAMENUMBER",), not_empty=True)
    assert df.count() == 100
    assert df.filter("ANIMALID = 1 and FRAMENUMBER > 30").count() == sum(k % 2 == 1 and k % 40 > 30 for k in range(1, 101))
    assert df.count() == 100
    assert sqlite.read(spark, path, "DETECTION", where=(("ANIMALID", "=", 1), ("_rowid", "<=", 10))).count() == 5
    assert [c for c, _, key in sqlite.columns(path, "DETECTION") if key] == ["ID"]
    assert sqlite.tables(path) == ["DETECTION"]
    with pytest.raises(Exception, match="none of the tables"):
        sqlite.read(spark, path, "NONE")
    with pytest.raises(ValueError, match="missing columns"):
        sqlite.read(spark, path, "DETECTION", require=("X",))
    out = str(tmp_path / "b.db")
    sqlite.write(df.orderBy("_rowid"), out, "COPY")
    assert sqlite.read(spark, out, "COPY").filter("NOTE = 'n7'").first()["MASS_X"] == 3.5


def test_command_line(spark, tmp_path):
    rows = [(1, 1, 5.0, 5.0), (2, 1, 5.0, 5.0), (2, 1, 5.0, 5.0), (3, 1, 5.0, 5.0), (3, 1, 999.0, 999.0), (4, 1, 5.0, 5.0)]
    raw, clean, filled = (str(tmp_path / x) for x in ("raw", "clean", "filled"))
    detections(spark, rows).write.parquet(raw)
    region = ["--nest", "0", "10", "0", "10", "--buffer", "-5", "15", "-5", "15"]
    assert main(["fill", raw, filled, *region], spark) == 1  # duplicates
    assert main(["dedup", raw, clean], spark) == 0
    assert main(["dedup", raw, clean], spark) == 1  # is there
    assert main(["dedup", raw, clean, "--overwrite"], spark) == 0
    assert main(["fill", clean, filled, *region], spark) == 0
    assert sorted((r["FRAMENUMBER"], r["IN_NEST"]) for r in spark.read.parquet(filled).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert main(["dedup", str(tmp_path / "none"), clean], spark) == 1


EVENTS = [(1, 1, "ANSWER", 10, 1, None), (1, 2, "ANSWER", 10, 0, None), (1, 3, "UNDO", None, None, None), (1, 4, "REDO", None, None, None), (1, 5, "UNDO", None, None, None), (1, 6, "ANSWER", 11, -1, 5), (1, 7, "REDO", None, None, None), (1, 8, "ANSWER", 12, 1, 3), (2, 1, "UNDO", None, None, None), (2, 2, "ANSWER", 5, 1, 0)]


def test_answer_log(spark, tmp_path):
    want = [(1, 1, 1, 10, 1), (1, 2, 6, 11, -1), (2, 1, 2, 5, 1)]
    df = spark.createDataFrame(EVENTS, log.LOG)
    assert sorted(map(tuple, log.replay(df).collect())) == want
    source = str(tmp_path / "log")
    for part in (EVENTS[:4], EVENTS[4:]):
        spark.createDataFrame(part, log.LOG).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.LOG).option("maxFilesPerTrigger", 1).parquet(source)
    found, sent = {}, []

    def keep(batch, _):
        rows = batch.collect()
        sent.append(len(rows))
        for r in rows:
            found[r["session"], r["position"]] = tuple(r)

    q = log.stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(x for x in found.values() if x[2] is not None) == want
    assert sum(sent) <= len(EVENTS)  # changes only
