"""Queries run over all animals; strata, reports and commands of tables of several animals."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frameloom.cli import main
from frameloom.config import ASSUMED, DETECTED, Config
from frameloom.operators import gaps, pools, review
from frameloom.plans import report, text
from frameloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FRAMES = "ANIMALID long, FRAMENUMBER long, IN_NEST int, ASSUMPTION_TYPE string, GAP_START_FRAME long, GAP_END_FRAME long"
GAPS = "ANIMALID long, GAP_START_FRAME long, GAP_END_FRAME long, size long, gap_type string, fill int, route string"


def test_no_query_is_of_one_animal(spark):
    assert not [n for n, sql in ORACLES.items() if "ANIMALID = 7" in sql]
    detected = {r["ANIMALID"]: r["detected"] for r in QUERIES["q_detected_counts"](spark, SF).collect()}
    missing = {r["ANIMALID"]: r["missing"] for r in QUERIES["q_gap_fill_summary"](spark, SF).collect()}
    assert len(detected) > 1
    for name in ("q_gap_fill_frames", "q_review_frames"):
        frames = {r["ANIMALID"]: r["n"] for r in QUERIES[name](spark, SF).groupBy("ANIMALID").agg(F.sum("n").alias("n")).collect()}
        assert frames == {a: n + missing[a] for a, n in detected.items()}
    for name in ("q_gap_fill_timeline", "q_review_timeline"):
        ranges = QUERIES[name](spark, SF)
        assert gaps.frames(ranges).select("ANIMALID", "FRAMENUMBER").distinct().count() == sum(detected.values()) + sum(missing.values())
    assert {r["ANIMALID"] for r in QUERIES["q_roi_metadata_roundtrip"](spark, SF).collect()} == set(detected)


def test_ranges_and_frames_give_the_same_samples(spark):
    rng = random.Random(3)
    ranges, at = [], 0
    for k in range(40):
        n = rng.randint(1, 30)
        ranges.append((rng.randint(1, 3), at + 1, at + n, k % 2, ASSUMED, at, at + n + 1))
        at += n + 2
    table = spark.createDataFrame(ranges, "ANIMALID long, first_frame long, last_frame long, IN_NEST int, ASSUMPTION_TYPE string, GAP_START_FRAME long, GAP_END_FRAME long")
    for n in (1, 17, 200):
        assert sorted(map(tuple, pools.sample(table, n, 5).collect())) == sorted(map(tuple, pools.sample(gaps.frames(table), n, 5).collect()))
        given = pools.allocation(table, n).collect()
        total = sum(r["size"] for r in given)
        floors = [n * r["size"] // total for r in given]
        assert sum(r["allocated"] for r in given) == n
        assert all(f <= r["allocated"] <= f + 1 for f, r in zip(floors, given))


def test_equal_gaps_of_two_animals_are_two_strata(spark):
    rows = [(a, f, 1, ASSUMED, 0, 11) for a in (1, 2) for f in range(1, 11)] + [(None, 5, 1, DETECTED, None, None)]
    t = spark.createDataFrame(rows, FRAMES)
    assert sorted((str(r["ANIMALID"]), r["size"]) for r in pools.allocation(t, 7).collect()) == [("1", 10), ("2", 10), ("None", 1)]
    with pytest.raises(ValueError, match="one animal"):
        pools.require_one_animal(t)
    with pytest.raises(ValueError, match="one animal"):
        pools.require_one_animal(t.filter("ANIMALID is null"))
    assert pools.require_one_animal(t.filter("ANIMALID = 1")).count() == 10


def test_a_table_without_gap_columns_is_sampled_as_a_whole(spark):
    t = spark.createDataFrame([(f, 1) for f in range(50)], "FRAMENUMBER long, IN_NEST int")
    drawn = pools.sample(t, 8, 3).collect()
    assert len({r["FRAMENUMBER"] for r in drawn}) == 8
    assert drawn[0].asDict().keys() == {"FRAMENUMBER", "IN_NEST"}
    assert [tuple(r) for r in pools.allocation(t, 8).collect()] == [(50, 8)]


def test_an_unknown_gap_type_is_an_error(spark):
    g = spark.createDataFrame([(1, 0, 2001, 2000, "99", -1, "bisect")], GAPS)
    with pytest.raises(Exception, match="unknown gap type 99"):
        review.segments(g, lambda m: F.lit(1)).collect()
    with pytest.raises(ValueError, match="without a type"):
        gaps.require_types(g)


def test_the_last_of_several_answers_counts(spark):
    g = spark.createDataFrame([(1, 0, 1501, 1500, "10", -1, "bisect")], GAPS)
    for rows, kind, want in (([(1, 750, 1, 1), (1, 750, 0, 2)], ", seq long", 0), ([(1, 750, 1), (1, 750, 0)], "", 1)):
        answers = spark.createDataFrame(rows, "ANIMALID long, FRAMENUMBER long, answer int" + kind)
        found = review.segments(review.answers_map(g, answers), lambda m: F.element_at(F.col("answers"), m)).collect()
        assert [(r["seg_start"], r["seg_end"], r["value"]) for r in found] == [(1, 1500, want)]


def test_states_asof(spark):
    rng = random.Random(4)
    det = {(a, f): rng.randint(0, 1) for a in (1, 2) for f in rng.sample(range(5, 400), 30)}
    asked = [(a, s, s + rng.randint(0, 90)) for a in (1, 2) for s in rng.sample(range(0, 410), 40)]
    got = gaps.states_asof(spark.createDataFrame(asked, "ANIMALID long, GAP_START_FRAME long, GAP_END_FRAME long"), spark.createDataFrame([(a, f, s) for (a, f), s in det.items()], "ANIMALID long, FRAMENUMBER long, IN_NEST int"), slice_frames=16)
    for r in got.collect():
        own = sorted(f for a, f in det if a == r["ANIMALID"])
        before = max((f for f in own if f <= r["GAP_START_FRAME"]), default=own[0])
        after = min((f for f in own if f >= r["GAP_END_FRAME"]), default=own[-1])
        assert (r["state_before"], r["state_after"]) == (det[r["ANIMALID"], before], det[r["ANIMALID"], after])
    assert got.count() == len(asked)


def test_totals_of_one_pass_agree_with_segments(spark):
    from frameloom.plans.catalogue import _answer, _det, _segments

    t = report.totals(_det(spark, SF), _answer).first()
    n = Counter()
    for r in _segments(spark, SF).collect():
        n[r["source"], r["value"]] += r["seg_end"] - r["seg_start"] + 1
    assert (t["bs_in"], t["bs_out"], t["bs_unknown"], t["logic_filled"]) == (n["BINARY_SEARCH", 1], n["BINARY_SEARCH", 0], n["BINARY_SEARCH", -1], n["LOGIC", 1])
    assert (t["untyped"], t["unbalanced"]) == (0, 0)
    assert len(report.require(report.checks(report.totals(_det(spark, SF), _answer))).collect()) == 7


def lines_of(df):
    return [r["text"] for r in df.orderBy("part", "line").collect()]


def test_report_text(spark):
    one = spark.createDataFrame([(54_000, 2)], "a long, b long")
    assert [tuple(r) for r in one.select(text.thousands(F.col("a")), text.triple(F.col("a")), text.of_percent(F.col("b"), F.col("a")), text.of_percent(F.col("b"), F.lit(0))).collect()] == [("54,000", "54,000  (00:30:00)  [0.500 h]", "0.0%", "0.0%")]
    assert text.region(None) == "not provided"
    assert text.region(Config().nest, "arguments") == "xmin=0.0, xmax=60.0, ymin=10.0, ymax=80.0  (source: arguments)"
    lines = [r["text"] for r in QUERIES["q_pipeline_report"](spark, SF).orderBy("part", "line").collect()]
    t = QUERIES["q_audit_table"](spark, SF).orderBy("line").collect()
    assert f"  remaining unknown: {t[5]['frames']:,}  ({t[5]['duration']})  [{t[5]['hours']:.3f} h]  running {t[5]['running']:,}" in lines
    assert lines[-2].endswith("  OK")
    assert [x for x in lines if x and not x.startswith((" ", "="))][:3] == ["Input", "Review timing", "Detected frames"]


def test_validation_report(spark):
    from frameloom.operators import metrics

    rows = [(1, 1, 1, "a.png"), (2, 1, 0, "b.png"), (3, 0, 0, "c.png"), (4, 1, None, "d.png")]
    t = spark.createDataFrame(rows, "sample_id long, IN_NEST int, MANUAL_QC int, screenshot string")
    found = lines_of(text.validation_report(metrics.confusion(t, F.col("IN_NEST"), F.col("MANUAL_QC")), metrics.mistakes(t), "DETECTED"))
    assert "  accuracy: 0.6667" in found and "b.png" in found
    assert found[found.index("False negatives") + 2] == "None"


def test_more_commands(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    det = [(f, 1, float(f % 7), 20.0) for f in [*range(0, 40), *range(3000, 3040)]] + [(3, 2, 1.0, 20.0)]
    spark.createDataFrame(det, "FRAMENUMBER long, ANIMALID long, MASS_X double, MASS_Y double").write.parquet(path("det"))
    spark.createDataFrame([(1, f, 1) for f in range(0, 4000)], "ANIMALID long, FRAMENUMBER long, answer int").write.parquet(path("answers"))
    spark.createDataFrame([(1, 40, 2999, 2, 9.0), (1, 40, 2999, 1, 75.0)], "ANIMALID long, first_frame long, last_frame long, seq long, duration_sec double").write.parquet(path("spent"))
    away = ["--nest", "0", "3", "10", "30", "--buffer", "-1", "3.5", "5", "35"]  # both ends of the gap are outside
    one = ["--animal-id", "1"]
    assert main(["report", path("det"), path("audit"), "--answers", path("answers"), "--text", path("report"), "--review-time", path("spent"), *one, *away], spark) == 0
    words = [r["value"] for r in spark.read.text(path("report")).collect()]
    assert any("00:01:15" in w for w in words) and any(w.endswith("(source: arguments)") for w in words)
    assert main(["review", path("det"), path("final"), "--answers", path("answers"), *one, *away], spark) == 0
    assert [r["FRAMENUMBER"] for r in spark.read.parquet(path("final")).collect()] == list(range(3040))
    assert main(["sample", path("det"), path("s0"), "--mode", "DETECTED", "--n", "5"], spark) == 1  # two animals
    assert main(["sample", path("final"), path("s1"), "--mode", "DETECTED", "--n", "5", "--text", path("t1")], spark) == 0
    drawn = spark.read.parquet(path("s1")).collect()
    assert len(drawn) == 5 and len({r["seed"] for r in drawn}) == 1
    spark.read.parquet(path("s1")).withColumns({"MANUAL_QC": F.lit(1), "sample_id": F.col("FRAMENUMBER"), "screenshot": F.lit("x.png")}).write.parquet(path("labelled"))
    assert main(["validate", path("labelled"), path("v"), "--text", path("t2")], spark) == 0
    assert spark.read.parquet(path("v")).first()["QC_MODE"] == "DETECTED"
    assert main(["velocity", path("det"), path("gaps.csv"), "--text", path("t3"), *one], spark) == 0
    rows = spark.read.option("header", True).csv(path("gaps.csv")).collect()
    assert [(r["start_frame"], r["velocity_before_px_per_sec"]) for r in rows] == [("39", "30.0")]
    assert main(["cut", path("det"), path("cut"), "--first", "3000", "--last", "3009"], spark) == 0
    assert spark.read.parquet(path("cut")).count() == 10
    spark.createDataFrame([("/v/a_t0.mp4", 100, 15.0)], "path string, frame_count long, fps double").write.parquet(path("files"))
    assert main(["videos", path("det"), path("shown"), "--files", path("files"), *one], spark) == 0
    assert spark.read.parquet(path("shown")).filter("local_frame = 99").count() == 40
