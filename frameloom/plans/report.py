"""Audit reports, each from gaps and decided ranges; no gap is expanded to frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, GAP_TYPES, Config
from ..functions.scalars import hms, hours, percent, seconds, share
from ..operators import gaps, review


def _size() -> Column:
    return F.col("seg_end") - F.col("seg_start") + 1


def _sum(where: Column, of: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, of)), F.lit(0)).cast("long")


def totals(classified: DataFrame, answer: Callable[[Column], Column], c: Config = DEFAULT, g: DataFrame | None = None) -> DataFrame:
    """One row with every count that the reports use, from one pass over detections and the gaps after them.

    `g` are gaps with a column of answers that `answer` reads; without it, answers come from the frame alone.
    """
    rows = gaps.with_gaps(classified, c)
    if g is not None:
        rows = rows.join(g.drop("size", "gap_type", "fill", "route"), ["ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME"], "left")
    size, r, gap = F.col("size"), F.col("route"), F.col("size") > 0
    segs = F.when(r.isin("checkpoints", "bisect"), review.decided(answer, c))
    said = lambda v: F.aggregate("segs", F.lit(0).cast("long"), lambda n, s: n + F.when(s["value"] == v, s["seg_end"] - s["seg_start"] + 1).otherwise(F.lit(0)))
    rows = rows.withColumn("segs", segs).withColumns({"in_": said(1), "out_": said(0), "unknown_": said(-1)})
    one = rows.agg(
        F.count("*").alias("det_total"), _sum(F.lit(True), F.col("IN_NEST").cast("long")).alias("det_in"),
        F.count_if(gap).alias("total_gaps"), _sum(gap, size).alias("asm_total"), _sum(r == "logic", size).alias("logic_filled"), _sum(gap & (r != "logic"), size).alias("bs_input"),
        _sum(r == "short", size).alias("threshold_skipped"), _sum(r == "short_00", size).alias("zz_skipped"), _sum(r == "checkpoints", size).alias("zz_reviewed"), _sum(r == "type_11", size).alias("ze_skipped"),
        *[_sum(gap & (F.col("gap_type") == t), size).alias(f"type_{t}") for t in GAP_TYPES],
        F.count_if(gap & ~F.coalesce(F.col("gap_type").isin(*GAP_TYPES), F.lit(False))).alias("untyped"),
        F.count_if(F.col("segs").isNotNull() & (F.col("in_") + F.col("out_") + F.col("unknown_") != size)).alias("unbalanced"),
        *[_sum(F.col("segs").isNotNull(), F.col(f"{k}_")).alias(f"bs_{k}") for k in ("in", "out", "unknown")],
    )
    return one.withColumns({"det_out": F.col("det_total") - F.col("det_in"), "searchable": F.col("bs_in") + F.col("bs_out") + F.col("bs_unknown")}).withColumns(
        {"final_in": F.col("det_in") + F.col("logic_filled") + F.col("bs_in"), "final_out": F.col("det_out") + F.col("bs_out"), "final_unknown": F.col("threshold_skipped") + F.col("zz_skipped") + F.col("ze_skipped") + F.col("bs_unknown")}
    )


def _lines(t: DataFrame, rows: list[tuple[str, Column]]) -> DataFrame:
    """A row (line, label, frames) for each of some columns of a one-row table."""
    return t.select(F.inline(F.array(*[F.struct(F.lit(k).alias("line"), F.lit(label).alias("label"), v.cast("long").alias("frames")) for k, (label, v) in enumerate(rows, 1)])))


def _timed(lines: DataFrame) -> DataFrame:
    s = seconds(F.col("frames"))
    return lines.withColumns({"duration": hms(s), "hours": hours(s)})


def processing(t: DataFrame) -> DataFrame:
    c = F.col
    lines = _lines(t, [("detected", c("det_total")), ("logic-filled", c("logic_filled")), ("sent to review", c("bs_input")), ("reviewed", c("searchable")), ("short 01/10 gaps", c("threshold_skipped")), ("short 00 gaps", c("zz_skipped")), ("reviewed 00 gaps", c("zz_reviewed")), ("11 gaps", c("ze_skipped"))])
    return _timed(lines)


def review_results(t: DataFrame) -> DataFrame:
    c = F.col
    return t.select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), c(v).alias("frames"), percent(c(v), c("bs_input")).alias("percent")) for k, v in (("in", "bs_in"), ("out", "bs_out"), ("unknown", "bs_unknown"), ("short 01/10", "threshold_skipped"), ("short 00", "zz_skipped"), ("type 11", "ze_skipped"))])))


def unknown_pools(t: DataFrame) -> DataFrame:
    c = F.col
    a = c("threshold_skipped") + c("zz_skipped")
    return t.select(F.inline(F.array(*[F.struct(F.lit(k).alias("pool"), v.alias("frames"), percent(v, c("final_unknown")).alias("percent")) for k, v in (("A: never reviewed", a), ("B: reviewer skipped", c("bs_unknown")), ("type 11", c("ze_skipped")))])))


def audit(t: DataFrame) -> DataFrame:
    """Every frame in one of six classes, with a running total."""
    c = F.col
    lines = _lines(t, [("Detected IN", c("det_in")), ("Detected OUT", c("det_out")), ("Logic-filled IN", c("logic_filled")), ("Binary-search IN", c("bs_in")), ("Binary-search OUT", c("bs_out")), ("Remaining UNKNOWN", c("final_unknown"))])
    return _timed(lines.withColumn("running", F.sum("frames").over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))))


def time_in_nest(t: DataFrame) -> DataFrame:
    c = F.col
    return _timed(_lines(t, [("total", c("final_in")), ("detected", c("det_in")), ("logic-filled", c("logic_filled")), ("binary-search", c("bs_in"))]))


def gap_stats(t: DataFrame, c: Config = DEFAULT) -> DataFrame:
    mean = share(F.col("asm_total"), F.col("total_gaps")) / F.lit(float(c.db_fps))
    return t.select("total_gaps", "asm_total", mean.alias("mean_sec"), hms(mean).alias("mean_hms"), hours(mean).alias("mean_hours"))


def checks(t: DataFrame) -> DataFrame:
    """label, expected, actual, ok of each identity that must hold."""
    c = F.col
    rows = [
        ("logic_filled + bs_input = asm_total", c("asm_total"), c("logic_filled") + c("bs_input")),
        ("det + asm = total", c("det_in") + c("det_out") + c("asm_total"), c("det_total") + c("asm_total")),
        ("bs_input is accounted for", c("bs_input"), c("searchable") + c("threshold_skipped") + c("zz_skipped") + c("ze_skipped")),
        ("final classes = total", c("det_total") + c("asm_total"), c("final_in") + c("final_out") + c("final_unknown")),
        ("gap types = asm_total", c("asm_total"), sum((c(f"type_{x}") for x in GAP_TYPES), F.lit(0))),
        ("gaps without a known type", F.lit(0), c("untyped")),
        ("reviewed gaps whose ranges do not sum up", F.lit(0), c("unbalanced")),
    ]
    return t.select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), e.cast("long").alias("expected"), a.cast("long").alias("actual"), (e == a).alias("ok")) for k, e, a in rows])))


def require(checked: DataFrame) -> DataFrame:
    if bad := checked.filter("not ok").collect():
        raise ValueError("; ".join(f"{r['label']}: expected {r['expected']}, got {r['actual']}" for r in bad))
    return checked


def detection_summary(t: DataFrame) -> DataFrame:
    """Detected frames, in and out, with their share of all detected ones."""
    c = F.col
    lines = _lines(t, [("detected", c("det_total")), ("in", c("det_in")), ("out", c("det_out"))])
    whole = t.select(c("det_total").alias("_whole"))
    return _timed(lines).join(F.broadcast(whole), how="cross").withColumn("percent", percent(c("frames"), c("_whole"))).drop("_whole")


def gap_totals(details: DataFrame) -> DataFrame:
    """The totals of a table of gap details, and whether they balance."""
    n = lambda k: F.coalesce(F.sum(k), F.lit(0)).cast("long")
    t = details.agg(F.count("*").alias("n_gaps"), n("frames").alias("frames"), *[n(f"{k}_frames").alias(f"{k}_frames") for k in ("in", "out", "unknown")])
    return t.withColumn("balanced", F.col("frames") == F.col("in_frames") + F.col("out_frames") + F.col("unknown_frames"))


def with_review_time(details: DataFrame, spent: DataFrame) -> DataFrame:
    """Gap details with review_time, as HH:MM:SS or N/A, from seconds spent (ANIMALID, first_frame, last_frame, seq, duration_sec): of several visits to a gap's frames the first counts."""
    first = spent.groupBy("ANIMALID", "first_frame", "last_frame").agg(F.min_by("duration_sec", "seq").alias("_spent"))
    first = first.select("ANIMALID", (F.col("first_frame") - 1).alias("GAP_START_FRAME"), (F.col("last_frame") + 1).alias("GAP_END_FRAME"), "_spent")
    return details.join(first, ["ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME"], "left").withColumn("review_time", F.when(F.col("_spent").isNotNull(), hms(F.col("_spent"))).otherwise(F.lit("N/A"))).drop("_spent")


def gap_details(segments: DataFrame) -> DataFrame:
    """Per gap the frames in, out and unknown, and what decided them."""
    n = lambda v: _sum(F.col("value") == v, _size())
    d = segments.groupBy("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "gap_type", "route").agg(n(1).alias("in_frames"), n(0).alias("out_frames"), n(-1).alias("unknown_frames"))
    i, o, u = F.col("in_frames") > 0, F.col("out_frames") > 0, F.col("unknown_frames") > 0
    label = (
        F.when(F.col("route") == "short_00", "skipped: short 00").when(F.col("route") == "type_11", "skipped: 11").when(F.col("route") == "logic", "logic-filled").when(F.col("route") == "short", "skipped: short")
        .when(i & ~o & ~u, "reviewed: in").when(o & ~i & ~u, "reviewed: out").otherwise("reviewed: mixed")
    )
    return d.withColumn("label", label).withColumn("frames", F.col("GAP_END_FRAME") - F.col("GAP_START_FRAME") - 1)
