"""Every query over the event tables, by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..config import ASSUMED, BINARY_SEARCH, DEFAULT, DETECTED, LOGIC, Config
from ..functions.scalars import hms, hours, seconds
from ..operators import dedup, gaps, metrics, pools, review, running, trajectory, video
from ..sources import events as ev
from ..sources.metadata import roi_metadata
from ..streaming import answers as log
from ..streaming import gap_stream as gap_stream_
from ..streaming import labels
from ..streaming import live_review as live_review_
from . import report, text
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The seed of samples.
SEED = 42
#: Dense fixture: larger distance and shorter runs than the defaults, which would give no bouts there.
DENSE = Config(stationary_distance=40.0, stationary_pairs=3)


def query(f: Query) -> Query:
    QUERIES[f"q_{f.__name__}"] = f
    return f


def _det(s: SparkSession, d: str) -> DataFrame:
    return gaps.classify(dedup.dedup(ev.detections(s, d)))


def _gaps(s: SparkSession, d: str) -> DataFrame:
    return gaps.gaps(_det(s, d))


def _answer(frame):
    return ev.reviewer(F.col("ANIMALID"), frame)


def _segments(s: SparkSession, d: str) -> DataFrame:
    return review.all_segments(_gaps(s, d), _answer)


def _totals(s: SparkSession, d: str) -> DataFrame:
    return report.totals(_det(s, d), _answer)


def _ranges(s: SparkSession, d: str) -> DataFrame:
    """The final timeline, as ranges of frames."""
    return gaps.ranges(_det(s, d), _segments(s, d))


def _sums(ranges: DataFrame, *by: str) -> DataFrame:
    """Every frame counts and the result stays small: frames of ranges counted and summed, without a row for each."""
    square = running.over_frames(ranges, {"square_sum": lambda _, f: f * f % 1_000_003}, 1_000_003)
    n, ends = pools.sizes(ranges), F.col("first_frame") + F.col("last_frame")
    half = lambda x: F.shiftright(x, 1)
    frames = F.when(n % 2 == 0, half(n) * ends).otherwise(n * half(ends))  # one of the two is even
    return square.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(frames).alias("frame_sum"), F.sum("square_sum").alias("square_sum"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return gaps.frames(_ranges(s, d)).withColumn("MANUAL_QC", ev.labeller(F.col("ANIMALID"), F.col("FRAMENUMBER"), F.col("IN_NEST")))


@query
def dedup_clean(s, d):
    return dedup.dedup(ev.detections(s, d))


@query
def dedup_stats(s, d):
    return dedup.stats(ev.detections(s, d))


@query
def dedup_conflict_examples(s, d):
    return dedup.conflicts(ev.detections(s, d))


@query
def detected_classify(s, d):
    return _det(s, d).select("ANIMALID", "FRAMENUMBER", "IN_NEST", "in_buffer")


@query
def detected_counts(s, d):
    return gaps.counts(_det(s, d))


@query
def gap_table(s, d):
    return _gaps(s, d).select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "size", "fill")


@query
def gap_fill_timeline(s, d):
    """Every frame of every animal, as ranges."""
    return gaps.rule_ranges(_det(s, d), _gaps(s, d))


@query
def gap_fill_frames(s, d):
    """The frames of the same, counted and summed."""
    return _sums(gaps.rule_ranges(_det(s, d), _gaps(s, d)), "ANIMALID", "ASSUMPTION_TYPE", "IN_NEST")


@query
def gap_fill_summary(s, d):
    """Per animal: detected frames, gaps, missing frames and frames in the nest, detected or filled by rule; detections and the gaps after them are counted together."""
    gap, size = F.col("size") > 0, F.col("size")
    n = lambda v: F.coalesce(F.sum(v), F.lit(0)).cast("long")
    found = gaps.with_gaps(_det(s, d)).groupBy("ANIMALID").agg(
        F.count("*").alias("detected"), n("IN_NEST").alias("detected_in"), n(1 - F.col("IN_NEST")).alias("detected_out"),
        F.count_if(gap).alias("n_gaps"), n(size).alias("missing"), n(F.when(F.col("route") == "logic", size)).alias("logic_filled"),
    )
    return found.withColumn("time_in_nest_sec", seconds(F.col("detected_in") + F.col("logic_filled")))


@query
def gap_stream(s, d):
    """The same gaps from the streaming detector over raw detections, duplicates and conflicts included."""
    return gap_stream_.current(gap_stream_.changes(ev.detections(s, d), None)).select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "size", "gap_type", "fill", "route")


@query
def nonincreasing_guard(s, d):
    return gaps.nonincreasing(ev.detections(s, d))


@query
def gap_types(s, d):
    return _gaps(s, d).select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "gap_type")


@query
def gap_type_frames(s, d):
    every = s.createDataFrame([("00",), ("01",), ("10",), ("11",)], "gap_type string")
    found = _gaps(s, d).groupBy("gap_type").agg(F.count("*").alias("n_gaps"), F.sum("size").alias("frames"))
    return every.join(found, "gap_type", "left").na.fill(0, ["n_gaps", "frames"])


@query
def gap_routes(s, d):
    return gaps.numbered(_gaps(s, d)).select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "route", "gap_index", "total_gaps")


@query
def boundary_asof(s, d):
    """The states around gaps from a table whose bounds are frames that were missed: the last detection before and the first after."""
    det = _det(s, d)
    g = _gaps(s, d).select("ANIMALID", (F.col("GAP_START_FRAME") + 1).alias("GAP_START_FRAME"), (F.col("GAP_END_FRAME") - 1).alias("GAP_END_FRAME"))
    return gaps.states_asof(g, det)


@query
def type00_checkpoints(s, d):
    return gaps.checkpoints(_gaps(s, d))


@query
def review_segments(s, d):
    return review.segments(_gaps(s, d), _answer)


@query
def review_answers_table(s, d):
    """The same review from a table of answers, none of which is computed in the fold."""
    g = _gaps(s, d)
    asked = review.segments(g, _answer).select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "seg_start", "seg_end", "value")
    # The frame that was shown is an end or the middle of what an answer fills; all of these are offered as answers.
    frames = asked.select("ANIMALID", F.explode(F.array_distinct(F.array("seg_start", "seg_end", F.floor((F.col("seg_start") + F.col("seg_end")) / 2)))).alias("FRAMENUMBER"))
    table = frames.distinct().withColumn("answer", ev.reviewer(F.col("ANIMALID"), F.col("FRAMENUMBER")))
    with_map = review.answers_map(g, table)
    return review.segments(with_map, lambda m: F.element_at(F.col("answers"), m))


@query
def live_review(s, d):
    """The same review given live: answers with wrong ones taken back, stale and repeated events, applied one by one to each animal's state."""
    g = kept(_gaps(s, d).filter("route in ('checkpoints', 'bisect')"))
    return live_review_.decided(live_review_.live(live_review_.scripted(review.resolve(g, _answer)), g))


@query
def review_timeline(s, d):
    """Every frame of every animal after review, as ranges."""
    return _ranges(s, d)


@query
def review_frames(s, d):
    """The frames of the same, counted and summed."""
    return _sums(_ranges(s, d), "ANIMALID", "FILL_SOURCE", "IN_NEST")


@query
def fill_source_counts(s, d):
    size = F.col("seg_end") - F.col("seg_start") + 1
    found = _segments(s, d).groupBy(F.col("source").alias("FILL_SOURCE"), F.col("value").cast("int").alias("IN_NEST")).agg(F.sum(size).alias("frames"))
    return found.unionByName(_det(s, d).groupBy(F.lit(DETECTED).alias("FILL_SOURCE"), "IN_NEST").agg(F.count("*").alias("frames")))


@query
def time_in_nest(s, d):
    return report.time_in_nest(_totals(s, d))


@query
def processing_breakdown(s, d):
    return report.processing(_totals(s, d))


@query
def review_results(s, d):
    return report.review_results(_totals(s, d))


@query
def unknown_pools(s, d):
    return report.unknown_pools(_totals(s, d))


@query
def audit_table(s, d):
    return report.audit(_totals(s, d))


@query
def gap_details(s, d):
    return report.gap_details(_segments(s, d))


@query
def gap_totals(s, d):
    return report.gap_totals(report.gap_details(_segments(s, d)))


@query
def gap_review_time(s, d):
    """Gaps with the time of their first review; each was visited twice, the later time first in the table."""
    details = report.gap_details(_segments(s, d))
    asked = _gaps(s, d).filter("route in ('checkpoints', 'bisect')")
    visit = F.explode(F.array(F.lit(2), F.lit(1))).alias("seq")
    spent = asked.select("ANIMALID", (F.col("GAP_START_FRAME") + 1).alias("first_frame"), (F.col("GAP_END_FRAME") - 1).alias("last_frame"), visit)
    spent = spent.withColumn("duration_sec", ((F.col("first_frame") * F.col("seq")) % 7200).cast("double"))
    return report.with_review_time(details, spent).select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "review_time")


@query
def detection_summary(s, d):
    return report.detection_summary(_totals(s, d))


@query
def pipeline_report(s, d):
    """The report as lines of text, without the table of gaps, whose rows q_gap_details has."""
    lines = text.pipeline_report(_totals(s, d), report.gap_details(_segments(s, d)), sources={"detections": "events"})
    return lines.filter("part <> 12").select("part", "line", "text")


@query
def integrity_checks(s, d):
    return report.checks(_totals(s, d))


@query
def gap_stats_hms(s, d):
    return report.gap_stats(_totals(s, d))


def _pool(mode):
    return lambda s, d: pools.pool(_ranges(s, d), mode, with_source=True).select("ANIMALID", "first_frame", "last_frame", "IN_NEST", "GAP_START_FRAME", "GAP_END_FRAME")


for _mode, _name in ((DETECTED, "detected"), (BINARY_SEARCH, "binary_search"), (LOGIC, "logic"), (ASSUMED, "assumed_legacy")):
    QUERIES[f"q_pool_{_name}"] = _pool(_mode)


@query
def pool_legacy_schema(s, d):
    """Frames of the pools in tables that have an integer BINARY_SEARCH, or nothing, instead of FILL_SOURCE."""
    t = _ranges(s, d)
    old = t.withColumn("BINARY_SEARCH", (F.col("FILL_SOURCE") == BINARY_SEARCH).cast("int")).withColumn("FILL_SOURCE", F.lit(None).cast("string"))
    cases = [("flag", old, BINARY_SEARCH), ("flag", old, LOGIC), ("none", t.drop("FILL_SOURCE"), LOGIC), ("none", t.drop("FILL_SOURCE"), ASSUMED)]
    out = None
    for schema, table, mode in cases:
        one = pools.pool(table, mode, with_source=False).agg(F.sum(pools.sizes(t)).alias("n")).select(F.lit(schema).alias("schema"), F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _review_pool(s: SparkSession, d: str) -> DataFrame:
    return pools.pool(_ranges(s, d), BINARY_SEARCH, with_source=True)


@query
def sample_allocation(s, d):
    """Over all reviewed gaps of all animals."""
    return pools.allocation(_review_pool(s, d), DEFAULT.samples)


@query
def sample_allocation_detected(s, d):
    """An animal's detected rows are one stratum, without a gap."""
    return pools.allocation(pools.pool(_ranges(s, d), DETECTED), DEFAULT.samples)


@query
def sample_allocation_plain(s, d):
    """A table without gaps or animals is one stratum."""
    return pools.allocation(_ranges(s, d).select("first_frame", "last_frame"), DEFAULT.samples)


@query
def stratified_sample(s, d):
    return pools.sample(_review_pool(s, d), DEFAULT.samples, SEED).select("ANIMALID", "FRAMENUMBER", "IN_NEST", "GAP_START_FRAME", "GAP_END_FRAME")


@query
def video_map(s, d):
    return video.video_map(ev.video_files(s, d))


@query
def video_rejects(s, d):
    return video.rejects(ev.video_files(s, d))


@query
def frame_exact(s, d):
    c = video.candidates(_det(s, d), video.video_map(ev.video_files(s, d)))
    return c.filter("resolved = FRAMENUMBER").select("ANIMALID", "FRAMENUMBER", "path")


@query
def frame_candidates(s, d):
    return video.candidates(_det(s, d), video.video_map(ev.video_files(s, d))).select("ANIMALID", "FRAMENUMBER", "candidate_rank", "resolved", "path")


@query
def frame_resolved_local(s, d):
    return video.resolved(_det(s, d), video.video_map(ev.video_files(s, d)), ev.unreadable(s, d))


@query
def qc_samples(s, d):
    drawn = pools.sample(_review_pool(s, d), DEFAULT.samples, SEED)
    return video.samples(drawn, video.video_map(ev.video_files(s, d)), BINARY_SEARCH, ev.unreadable(s, d))


def _by_mode(s, d):
    """Labelled frames of the three pools, which share no frame: one pass tells them all; a range's frames with the same label are counted together."""
    mode = F.when(F.col("ASSUMPTION_TYPE") == DETECTED, DETECTED).when(F.col("IN_NEST").isin(0, 1) & F.col("FILL_SOURCE").isin(BINARY_SEARCH, LOGIC), F.col("FILL_SOURCE"))
    pooled = _ranges(s, d).withColumn("qc_mode", mode).filter("qc_mode is not null")
    return metrics.confusion(ev.labelled_ranges(pooled), F.col("IN_NEST"), F.col("MANUAL_QC"), ("qc_mode",), F.col("n"))


@query
def confusion_by_mode(s, d):
    return _by_mode(s, d).select("qc_mode", "TP", "FP", "FN", "TN", "total_labeled", "invalid")


@query
def qc_metrics(s, d):
    return _by_mode(s, d).select("qc_mode", "accuracy", "error_rate", "sensitivity", "specificity")


@query
def fp_fn_list(s, d):
    t = _labelled(s, d).withColumns({"sample_id": F.col("FRAMENUMBER"), "screenshot": F.format_string("A%d_G%d.png", "ANIMALID", "FRAMENUMBER")})
    return metrics.mistakes(pools.pool(t, DETECTED))


@query
def excluded_counts(s, d):
    t = _ranges(s, d)
    return metrics.excluded(t, pools.pool(t, BINARY_SEARCH, with_source=True))


@query
def labels_confusion(s, d):
    return metrics.confusion(s.read.parquet(f"{d}/labels.parquet"), F.col("quality"), F.col("toxic"))


def _bouts(s, d):
    return trajectory.bouts(ev.dense(s, d), DENSE)


@query
def bouts(s, d):
    return _bouts(s, d)


@query
def bout_stats(s, d):
    return trajectory.distribution(_bouts(s, d), "pairs", by=("ANIMALID",))


@query
def suggest_threshold(s, d):
    """For every animal, those without bouts too."""
    animals = ev.dense(s, d).select("ANIMALID").distinct()
    spread = trajectory.distribution(_bouts(s, d), "pairs", by=("ANIMALID",))
    return trajectory.suggested_minutes(animals.join(spread, "ANIMALID", "left").na.fill(0, ["n"]), ("ANIMALID",))


@query
def bout_histogram(s, d):
    return trajectory.histogram(_bouts(s, d).withColumn("minutes", F.col("duration_sec") / 60.0), "minutes", 1.0, ("ANIMALID",))


@query
def velocity_gaps(s, d):
    return trajectory.velocity_gaps(ev.dense(s, d))


@query
def gap_percentiles(s, d):
    return trajectory.distribution(trajectory.velocity_gaps(ev.dense(s, d)), "gap_length_frames", by=("ANIMALID",))


@query
def gap_percentiles_all(s, d):
    """Of the gaps between detections of all animals together."""
    return trajectory.distribution(_gaps(s, d), "size")


@query
def gap_histogram(s, d):
    return trajectory.histogram(trajectory.velocity_gaps(ev.dense(s, d)).withColumn("minutes", F.col("gap_duration_sec") / 60.0), "minutes", 0.1, ("ANIMALID",))


@query
def recording_overview(s, d):
    o = trajectory.overview(_det(s, d))
    return o.withColumns({"duration": hms(F.col("duration_sec")), "hours": hours(F.col("duration_sec"))})


@query
def trajectory_norm(s, d):
    return trajectory.normalised(_det(s, d))


@query
def frame_range_cut(s, d):
    cut = trajectory.cut({"detection": ev.detections(s, d), "regions": roi_metadata(s, [(7,)])}, 1000, 20000)
    out = None
    for name, table in cut.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query
def roi_metadata_roundtrip(s, d):
    """A row of regions for each animal."""
    return _det(s, d).select("ANIMALID").distinct().join(F.broadcast(roi_metadata(s, [(0,)]).drop("ANIMALID")), how="cross")


@query
def label_latest_wins(s, d):
    """The log of labels: each sample's last entry counts."""
    entries = ev.events(s, d).select((F.col("event_id") % 500).alias("sample_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 2).cast("int").alias("label"))
    return metrics.latest(entries)


@query
def label_metrics(s, d):
    """The confusion matrix of each mode as the sum of what every label changes."""
    return labels.metrics(labels.totals(labels.differences(ev.label_log(s, d), ev.predictions(s, d))))


@query
def review_seconds(s, d):
    """Time spent on each gap in its first visit, from a log of answers with times."""
    timed = ev.events(s, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("gap"), "ts")
    return log.review_seconds(timed)


@query
def answer_log_replay(s, d):
    """Effective answers of every session after undo, redo and stale events."""
    return log.replay(log.events_as_log(ev.events(s, d)))
