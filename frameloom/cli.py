"""Commands over tables of detections: python -m frameloom.cli COMMAND --help."""

from __future__ import annotations

import argparse
import random
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import kept
from .config import Config, Region
from .operators import dedup, gaps, metrics, pools, review, trajectory, video
from .plans import report, text
from .sources import metadata, sqlite, videos
from .streaming import live_review


def load(spark: SparkSession, path: str, table: str = "DETECTION") -> DataFrame:
    """Parquet, or a table of an SQLite file (.sqlite, .db), with _rowid."""
    if path.endswith((".sqlite", ".db")):
        return sqlite.read(spark, path, table)
    df = spark.read.parquet(path)
    return df if "_rowid" in df.columns else df.withColumn("_rowid", F.monotonically_increasing_id())


def save(df: DataFrame, path: str, overwrite: bool) -> None:
    """Parquet, or CSV with a header if the path ends so; timelines are sorted by animal and frame."""
    order = [c for c in ("ANIMALID", "FRAMENUMBER", "start_frame") if c in df.columns]
    out = (df.orderBy(*order) if order else df).write.mode("overwrite" if overwrite else "errorifexists")
    out.option("header", True).csv(path) if path.endswith(".csv") else out.parquet(path)


COMMANDS = {
    "dedup": "one detection for each frame and animal",
    "fill": "timeline with gaps filled by rule",
    "review": "final timeline from a table of answers (ANIMALID, FRAMENUMBER, answer and, where answers were changed, seq)",
    "report": "audit table, and the whole report as text with --text",
    "sample": "stratified sample of a final timeline of one animal",
    "validate": "confusion matrix of a table of samples with MANUAL_QC",
    "bouts": "stationary bouts",
    "velocity": "gaps with the speed before and after, for a CSV table",
    "cut": "detections from --first to --last; from one SQLite file to another, all of its tables",
    "live": "changes of a live review, as Parquet, from a folder of events (--events) that is read to its end",
    "regions": "write the regions given by --nest and --buffer, or those that another table of regions has, as a table of regions",
    "probe": "path, frame_count and fps of the video files in a folder",
    "videos": "which of the videos (path, frame_count, fps) shows each frame",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="frameloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--overwrite", action="store_true")
        c.add_argument("--table", default="DETECTION", help="table of an SQLite file")
        c.add_argument("--animal-id", type=int)
        c.add_argument("--regions", help="table of regions (of the command regions) that counts where --nest and --buffer are not given")
        c.add_argument("--nest", type=float, nargs=4, metavar=("XMIN", "XMAX", "YMIN", "YMAX"))
        c.add_argument("--buffer", type=float, nargs=4, metavar=("XMIN", "XMAX", "YMIN", "YMAX"))
        if name in ("review", "report"):
            c.add_argument("--answers", required=True)
        if name in ("report", "sample", "validate", "velocity"):
            c.add_argument("--text", help="also write the report as text here")
        if name == "report":
            c.add_argument("--review-time", help="table of visits (ANIMALID, first_frame, last_frame, seq, duration_sec)")
        if name == "sample":
            c.add_argument("--mode", default="BINARY_SEARCH", choices=pools.MODES)
            c.add_argument("--n", type=int, default=100)
            c.add_argument("--seed", type=int, help="a fresh one if not given; it is recorded with the samples")
            c.add_argument("--files", help="videos (path, frame_count, fps): the samples become a numbered table with the frame of a video that shows each")
            c.add_argument("--unreadable", help="table (path) of videos that cannot be read")
        if name == "live":
            c.add_argument("--events", required=True, help="folder of Parquet files (session, seq, kind, answer, token)")
            c.add_argument("--state", help="folder of the stream's progress; OUTPUT_progress unless given")
        if name == "cut":
            c.add_argument("--first", type=int, required=True)
            c.add_argument("--last", type=int, required=True)
        if name == "videos":
            c.add_argument("--files", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("frameloom").getOrCreate()
    try:
        if a.command == "cut" and all(p.endswith((".sqlite", ".db")) for p in (a.input, a.output)):
            sqlite.cut_file(spark, a.input, a.output, a.first, a.last)
            return 0
        if a.command == "probe":
            save(videos.probe(spark, a.input), a.output, a.overwrite)
            return 0
        given, a.source = _regions(a, spark)
        config = Config(**given)
        if a.command == "regions":
            rows = load(spark, a.input, a.table)
            if not metadata.write(spark, a.output, int(pools.require_one_animal(rows).first()["ANIMALID"]), given.get("nest"), given.get("buffer"), a.overwrite):
                raise ValueError("no regions are given")
            return 0
        rows = load(spark, a.input, a.table)
        if a.animal_id is not None:
            rows = rows.filter(F.col("ANIMALID") == a.animal_id)
        if not rows.limit(1).count():
            raise ValueError("no rows")
        if a.command == "live":
            _live(a, rows, config)
        else:
            save(_run(a, rows, config), a.output, a.overwrite)
    except Exception as e:
        print(f"frameloom: {e}", file=sys.stderr)
        return 1
    return 0


def _regions(a: argparse.Namespace, spark: SparkSession) -> tuple[dict[str, Region], str]:
    """The regions and where they come from: arguments, else a table of regions, else the defaults."""
    given = {k: Region(*v) for k, v in (("nest", a.nest), ("buffer", a.buffer)) if v}
    if given or not a.regions:
        return given, "arguments" if given else "defaults"
    found = dict(zip(("nest", "buffer"), metadata.read(spark, a.regions), strict=True))
    return {k: v for k, v in found.items() if v is not None}, a.regions


def _live(a: argparse.Namespace, rows: DataFrame, config: Config) -> None:
    """Adds what the events that have come change; run again, it goes on where it stopped."""
    g = gaps.require_types(gaps.gaps(gaps.classify(gaps.require_increasing(rows), config), config))
    events = rows.sparkSession.readStream.schema(live_review.EVENTS).parquet(a.events)
    out = live_review.live(events, g, config).writeStream.outputMode("update").trigger(availableNow=True)
    out = out.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(a.output))
    out.option("checkpointLocation", a.state or f"{a.output.rstrip('/')}_progress").start().awaitTermination()


def _text(a: argparse.Namespace, lines: Callable[[], DataFrame]) -> None:
    if a.text:
        text.write(lines(), a.text, a.overwrite)


def _run(a: argparse.Namespace, rows: DataFrame, config: Config) -> DataFrame:
    spark = rows.sparkSession
    if a.command == "dedup":
        # Keys that number the rows of a file are no data.
        numbers = tuple(sqlite.surrogate_keys(a.input, a.table)) if a.input.endswith((".sqlite", ".db")) else ()
        return dedup.dedup(rows, numbers)
    if a.command == "sample":
        pool = pools.pool(pools.require_one_animal(rows), a.mode)
        seed = random.SystemRandom().randrange(1 << 31) if a.seed is None else a.seed
        drawn = pools.sample(pool, a.n, seed).withColumns({"QC_MODE": F.lit(a.mode), "seed": F.lit(seed)})
        drawn = kept(drawn)
        _text(a, lambda: text.sampler_report(pool, drawn, a.mode, seed))
        if a.files:
            bad = load(spark, a.unreadable) if a.unreadable else None
            return video.samples(drawn, video.video_map(load(spark, a.files)), a.mode, bad).withColumn("seed", F.lit(seed))
        return drawn
    if a.command == "validate":
        mode = pools.mode_of(rows)
        found = metrics.confusion(rows, F.col("IN_NEST"), F.col("MANUAL_QC"))
        _text(a, lambda: text.validation_report(found, metrics.mistakes(rows), mode))
        return found.withColumn("QC_MODE", F.lit(mode))
    if a.command == "bouts":
        return trajectory.bouts(gaps.require_increasing(rows), config)
    if a.command == "velocity":
        found = trajectory.velocity_gaps(gaps.require_increasing(rows), config)

        def lines() -> DataFrame:
            spread = trajectory.distribution(trajectory.bouts(pools.require_one_animal(rows), config), "pairs", config)
            return text.trajectory_report(trajectory.overview(rows, config), spread, trajectory.suggested_minutes(spread), trajectory.distribution(found, "gap_length_frames", config), config)

        _text(a, lines)
        return found.withColumns({c: F.round(c, 4) for c in found.columns if c.startswith("velocity") or c == "gap_duration_sec"})
    if a.command == "cut":
        return trajectory.cut({"rows": rows}, a.first, a.last)["rows"]
    if a.command == "videos":
        return video.resolved(rows, video.video_map(load(spark, a.files)))
    classified = gaps.classify(gaps.require_increasing(rows), config)
    found = gaps.require_types(gaps.gaps(classified, config))
    if a.command == "fill":
        return gaps.timeline(classified, found)
    with_answers = review.answers_map(found, load(spark, a.answers))
    answer = lambda m: F.element_at(F.col("answers"), m)
    totals = report.totals(classified, answer, config, with_answers)
    report.require(report.checks(totals))
    segments = review.all_segments(with_answers, answer, config)
    if a.command == "review":
        return gaps.final_timeline(classified, segments)

    def lines() -> DataFrame:
        details, spent = report.gap_details(segments), load(spark, a.review_time) if a.review_time else None
        total = float((spent.agg(F.sum("duration_sec").alias("s")).first()["s"] if spent is not None else 0.0) or 0.0)
        return text.pipeline_report(totals, report.with_review_time(details, spent) if spent is not None else details, config, {"detections": a.input, "answers": a.answers, "output": a.output, "regions": a.source}, total)

    _text(a, lines)
    return report.audit(totals)


if __name__ == "__main__":
    sys.exit(main())
