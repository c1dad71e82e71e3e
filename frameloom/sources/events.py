"""The event tables read as detections, answers, labels and videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import running

#: The labeller repeats itself after so many frames, and after so many animals.
LABELLER_PERIOD = 130


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detections, one minute a frame; every tenth is given twice."""
    frame = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 60000000")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = events(spark, sf_dir).select(F.col("event_id").alias("_rowid"), F.col("user_id").alias("ANIMALID"), frame.alias("FRAMENUMBER"), F.col("value").alias("MASS_X"), k.alias("MASS_Y"), F.col("event_type").alias("EVENT_TYPE"))
    again = F.when(F.col("_rowid") % 10 == 3, F.array(F.lit(0), F.lit(1_000_000_000))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_again", F.explode(again)).withColumn("_rowid", F.col("_rowid") + F.col("_again")).drop("_again")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All animals, half a day a frame, so most frames are there; of several events of a frame the last counts."""
    frame = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 12")
    k = F.get_json_object("props", "$.k").cast("double")
    e = events(spark, sf_dir).select(F.col("user_id").alias("ANIMALID"), frame.alias("FRAMENUMBER"), "event_id", F.col("value").alias("MASS_X"), k.alias("MASS_Y"))
    return e.groupBy("ANIMALID", "FRAMENUMBER").agg(F.max_by(F.struct("MASS_X", "MASS_Y"), "event_id").alias("_at")).select("ANIMALID", "FRAMENUMBER", "_at.MASS_X", "_at.MASS_Y")


def reviewer(animal: Column, frame: Column) -> Column:
    """A deterministic reviewer: -1 cannot judge, 1 in, 0 out."""
    return F.when((frame * 11 + animal) % 97 == 0, F.lit(-1)).when((frame * 7 + animal * 13) % 100 < 45, F.lit(1)).otherwise(F.lit(0)).cast("long")


def labeller(animal: Column, frame: Column, predicted: Column) -> Column:
    """A deterministic labeller; null where it gives none."""
    return F.when((frame * 5 + animal) % 13 == 0, F.lit(None).cast("int")).when((frame * 3 + animal) % 10 == 0, 1 - predicted).otherwise(predicted).cast("int")


def labelled_ranges(ranges: DataFrame) -> DataFrame:
    """The ranges with what the labeller gives to their frames: up to two rows each, with MANUAL_QC and the number n of frames that have it; frames without a label are left out."""
    label = lambda k, f: labeller(k, f, F.lit(0))
    kinds = {"_agree": lambda k, f: F.coalesce(label(k, f) == 0, F.lit(False)), "_differ": lambda k, f: F.coalesce(label(k, f) == 1, F.lit(False))}
    counted = running.over_frames(ranges, {c: lambda k, f, v=v: v(k, f).cast("int") for c, v in kinds.items()}, LABELLER_PERIOD, F.pmod("ANIMALID", F.lit(LABELLER_PERIOD)), LABELLER_PERIOD)
    given = F.inline(F.array(F.struct(F.col("IN_NEST").alias("MANUAL_QC"), F.col("_agree").alias("n")), F.struct((1 - F.col("IN_NEST")).alias("MANUAL_QC"), F.col("_differ").alias("n"))))
    return counted.select(*ranges.columns, given).filter("n > 0")


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of 500 samples, each given many times; some take a label back and some are neither 0 nor 1."""
    e = events(spark, sf_dir)
    label = F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("value") > 99, F.lit(2)).otherwise(F.col("user_id") % 2).cast("int")
    return e.select((F.col("event_id") % 500).alias("sample_id"), F.col("event_id").alias("seq"), label.alias("label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, qc_mode and predicted of these samples, by each one's first event."""
    first = events(spark, sf_dir).groupBy((F.col("event_id") % 500).alias("sample_id")).agg(F.min_by(F.struct("event_type", "value"), "event_id").alias("e"))
    predicted = F.when(F.col("e.event_type") == "error", -1).when(F.col("e.value") > 50, 1).otherwise(0)
    return first.select("sample_id", F.when(F.col("e.event_type").isin("click", "error"), "LOGIC").otherwise("DETECTED").alias("qc_mode"), predicted.alias("predicted"))


def video_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, frame_count and fps of a video for each web page: overlapping, nested, with holes between them where pages are few, some at another rate or without a frame number."""
    size, n = F.char_length("html"), F.col("page_id")
    named = F.when(F.col("url").contains("ref="), F.format_string("/videos/cam_%d_final.mp4", n)).otherwise(F.format_string("/videos/cam_t%d.mp4", n * 7919 % 50_000))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(named.alias("path"), (size % 200 + 1).cast("long").alias("frame_count"), F.when(size % 10 == 4, 12.0).otherwise(15.0).alias("fps"))


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos that cannot be read; from 50,000 pages on several of different lengths share a path."""
    return video_files(spark, sf_dir).filter("frame_count % 5 = 0").select("path", "frame_count")
