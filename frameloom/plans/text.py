"""Reports as lines of text: tables (part, line, text) that Spark formats and writes sorted; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, Region
from ..functions.scalars import hms, hours, percent, seconds
from ..operators.pools import sizes
from . import report


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n.cast("long"), 0)


def triple(frames: Column) -> Column:
    """Frames, their duration and decimal hours: 1,800  (00:01:00)  [0.017 h]."""
    s = seconds(frames)
    return F.format_string("%s  (%s)  [%.3f h]", thousands(frames), hms(s), hours(s))


def of_percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", percent(part, whole))


def region(r: Region | None, source: str = "") -> str:
    """A region and where it comes from; "not provided" without one."""
    if r is None:
        return "not provided"
    text = f"xmin={r.xmin}, xmax={r.xmax}, ymin={r.ymin}, ymax={r.ymax}"
    return f"{text}  (source: {source})" if source else text


def minutes(secs: Column) -> Column:
    return F.format_string("%.1f min", secs / 60.0)


def _texts(part: int, title: str, lines: list[tuple[str, Column | str]]) -> Column:
    """An array of (part, line, text): a title and a line "label: value" for each value."""
    texts = [F.lit(title), F.lit("=" * len(title)), *[F.concat(F.lit(f"  {label}: "), v if isinstance(v, Column) else F.lit(v)) for label, v in lines], F.lit("")]
    return F.array(*[F.struct(F.lit(part).alias("part"), F.lit(k).alias("line"), t.alias("text")) for k, t in enumerate(texts)])


def _part(one: DataFrame, part: int, title: str, lines: list[tuple[str, Column | str]]) -> DataFrame:
    """The lines of one part, from a one-row table."""
    return one.select(F.inline(_texts(part, title, lines)))


def _rows(rows: DataFrame, part: int, title: str, text: Column, order: list[str], header: str = "") -> DataFrame:
    """A title and a line for each row, in an order that the text is written in."""
    key = F.concat_ws("|", *[F.lpad(F.col(k).cast("string"), 20, "0") for k in order])
    first = rows.sparkSession.createDataFrame([(part, "", t) for t in (title, "=" * len(title), header) if t], "part int, line string, text string")
    return first.withColumn("line", F.format_string("%d", F.monotonically_increasing_id() % 8)).unionByName(rows.select(F.lit(part).alias("part"), F.concat(F.lit("a"), key).alias("line"), text.alias("text")))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.withColumn("line", F.when(F.lit(dict(p.dtypes)["line"] == "int"), F.lpad(F.col("line").cast("string"), 6, "0")).otherwise(F.col("line").cast("string"))) for p in parts])


def pipeline_report(totals: DataFrame, details: DataFrame, config: Config = DEFAULT, sources: dict[str, str] | None = None, review_seconds: float = 0.0) -> DataFrame:
    """What was read, timing, detected and assumed frames, types, processing, review, the audit, unknown pools, time in the nest, gaps and their table with totals and balance."""
    c = F.col
    one = totals.join(F.broadcast(report.gap_totals(details).select("balanced", *[F.col(f"{k}frames").alias(f"sum_{k}frames") for k in ("", "in_", "out_", "unknown_")])), how="cross")
    echo = [*(sources or {}).items(), ("nest", region(config.nest, (sources or {}).get("regions", ""))), ("buffer", region(config.buffer, (sources or {}).get("regions", "")))]
    running, audit = F.lit(0).cast("long"), []
    for label, v in (("detected in", "det_in"), ("detected out", "det_out"), ("logic-filled in", "logic_filled"), ("binary-search in", "bs_in"), ("binary-search out", "bs_out"), ("remaining unknown", "final_unknown")):
        running = running + c(v)
        audit.append((label, F.concat(triple(c(v)), F.lit("  running "), thousands(running))))
    parts = [
        _texts(1, "Input", [(k, v) for k, v in echo]),
        _texts(2, "Review timing", [("total review duration", F.concat(hms(F.lit(review_seconds)), F.format_string("  (%.3f h)", F.lit(review_seconds / 3600.0))))]),
        _texts(3, "Detected frames", [("total", triple(c("det_total"))), ("in the nest", triple(c("det_in"))), ("% of detected, in", of_percent(c("det_in"), c("det_total"))), ("out of the nest", triple(c("det_out"))), ("% of detected, out", of_percent(c("det_out"), c("det_total")))]),
        _texts(4, "Assumed frames", [("total", triple(c("asm_total"))), ("logic-filled", triple(c("logic_filled"))), ("% of assumed, logic-filled", of_percent(c("logic_filled"), c("asm_total"))), ("sent to review", triple(c("bs_input"))), ("% of assumed, sent to review", of_percent(c("bs_input"), c("asm_total")))]),
        _texts(5, "Gap types", [(t, F.concat(triple(c(f"type_{t}")), F.lit("  "), of_percent(c(f"type_{t}"), c("asm_total")))) for t in ("00", "01", "10", "11")]),
        _texts(6, "Processing", [(k, triple(c(v))) for k, v in (("reviewed", "searchable"), ("short 01/10 gaps", "threshold_skipped"), ("short 00 gaps", "zz_skipped"), ("reviewed 00 gaps", "zz_reviewed"), ("11 gaps", "ze_skipped"))]),
        _texts(7, "Review results", [(k, F.concat(triple(c(v)), F.lit("  "), of_percent(c(v), c("bs_input")))) for k, v in (("in", "bs_in"), ("out", "bs_out"), ("unknown", "bs_unknown"))]),
        _texts(8, "Unknown frames", [(k, F.concat(triple(v), F.lit("  "), of_percent(v, c("final_unknown")))) for k, v in (("never reviewed", c("threshold_skipped") + c("zz_skipped")), ("reviewer skipped", c("bs_unknown")), ("type 11", c("ze_skipped")))]),
        _texts(9, "Audit", audit),
        _texts(10, "Time in the nest", [(k, triple(c(v))) for k, v in (("total", "final_in"), ("detected", "det_in"), ("logic-filled", "logic_filled"), ("binary-search", "bs_in"))]),
        _texts(11, "Gaps", [("number", thousands(c("total_gaps"))), ("average duration", hms(F.when(c("total_gaps") > 0, seconds(c("asm_total") / c("total_gaps"))).otherwise(F.lit(0.0))))]),
        _texts(13, "Totals", [("frames", thousands(c("sum_frames"))), ("balance", F.concat(thousands(c("sum_in_frames")), F.lit(" in + "), thousands(c("sum_out_frames")), F.lit(" out + "), thousands(c("sum_unknown_frames")), F.lit(" unknown, expected "), thousands(c("sum_frames")), F.when(c("balanced"), F.lit("  OK")).otherwise(F.lit("  MISMATCH"))))]),
    ]
    # One row tells all parts but the table of gaps, so what it took to count is done once.
    table = _rows(details, 12, "Gap details", F.format_string("%d  %s  %d  %d  %d  %d  %d  %d  %s  %s  %s", "ANIMALID", "gap_type", "GAP_START_FRAME", "GAP_END_FRAME", "frames", "in_frames", "out_frames", "unknown_frames", hms(seconds(c("frames"))), c("review_time") if "review_time" in details.columns else F.lit("N/A"), c("label")), ["ANIMALID", "GAP_START_FRAME"], "animal  type  start  end  frames  in  out  unknown  duration  review  label")
    return _all([one.select(F.inline(F.flatten(F.array(*parts)))), table])


def validation_report(metrics: DataFrame, mistakes: DataFrame, mode: str) -> DataFrame:
    """A confusion matrix (one row of metrics.confusion), its rates, and the samples whose labels contradict."""
    c = F.col
    parts = [
        _part(metrics, 1, "QC validation", [("mode", mode), ("positive class", "in the nest"), ("labelled samples", thousands(c("total_labeled"))), *[(k, thousands(c(k))) for k in ("TP", "FP", "TN", "FN")]]),
        _part(metrics, 2, "Metrics", [(k, F.format_string("%.4f", c(k))) for k in ("accuracy", "error_rate", "sensitivity", "specificity")]),
    ]
    for k, (kind, title) in enumerate((("FP", "False positives"), ("FN", "False negatives")), 3):
        own = mistakes.filter(c("kind") == kind)
        parts.append(_rows(own, k, title, c("screenshot"), ["sample_id"]))
        parts.append(own.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(k).alias("part"), F.lit("a").alias("line"), F.lit("None").alias("text")))
    return _all(parts)


def trajectory_report(overview: DataFrame, bouts: DataFrame, suggested: DataFrame, gaps: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Of one animal: its recording, stationary bouts and gaps (each one row of trajectory.distribution), and the suggested interval."""
    c = F.col
    spread = [("found", thousands(c("n"))), ("mean", minutes(c("mean"))), ("median", minutes(c("p50"))), ("25th percentile", minutes(c("p25"))), ("75th percentile", minutes(c("p75"))), ("longest", minutes(c("max")))]
    return _all([
        _part(overview, 1, "Recording", [("animal", c("ANIMALID").cast("string")), ("detected frames", thousands(c("n"))), ("first frame", thousands(c("first_frame"))), ("last frame", thousands(c("last_frame"))), ("length", hms(c("duration_sec")))]),
        _part(bouts, 2, "Stationary bouts", [("displacement threshold", f"{config.stationary_distance} px"), ("minimum length", f"{config.stationary_pairs / config.db_fps:g} s"), *spread]),
        _part(suggested, 3, "Suggested interval", [("minutes", c("suggested_minutes").cast("string")), ("method", "75th percentile of bouts, rounded up to 5 minutes, from 5 to 60")]),
        _part(gaps, 4, "Missing gaps", spread),
    ])


def sampler_report(pool: DataFrame, drawn: DataFrame, mode: str, seed: int) -> DataFrame:
    """What a sample was drawn from: the pool's frames, the samples, mode and seed."""
    n = pool.agg(F.sum(sizes(pool)).alias("pool")).join(drawn.agg(F.count("*").alias("drawn")), how="cross")
    return _all([_part(n, 1, "Sample", [("mode", mode), ("frames in the pool", thousands(F.col("pool"))), ("samples", thousands(F.col("drawn"))), ("seed", str(seed))])])


def write(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """The lines in their order, as text files whose names sort likewise."""
    lines.orderBy("part", "line").select("text").write.mode("overwrite" if overwrite else "errorifexists").text(path)
