"""Confusion matrices of predictions and labels; labels as an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import share
from .pools import sizes


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """TP, FP, FN, TN, accuracy, error_rate, sensitivity, specificity and counts; rates are 0 where nothing is to be divided.

    Rows without a label are not counted; predictions other than 0 and 1 are
    counted as invalid and left out. A row counts once, or `weight` times.
    """
    labelled = rows.withColumns({"_p": predicted, "_a": actual}).filter("_a is not null")
    count = lambda where: F.count_if(where) if weight is None else F.coalesce(F.sum(F.when(where, weight)), F.lit(0)).cast("long")
    n = lambda p, a: count((F.col("_p") == p) & (F.col("_a") == a))
    valid = F.coalesce(F.col("_p").isin(0, 1), F.lit(False))
    m = labelled.groupBy(*by).agg(n(1, 1).alias("TP"), n(1, 0).alias("FP"), n(0, 1).alias("FN"), n(0, 0).alias("TN"), count(valid).alias("total_labeled"), count(~valid).alias("invalid"))
    right = F.col("TP") + F.col("TN")
    total = right + F.col("FP") + F.col("FN")
    return m.withColumns({"accuracy": share(right, total), "error_rate": share(F.col("FP") + F.col("FN"), total), "sensitivity": share(F.col("TP"), F.col("TP") + F.col("FN")), "specificity": share(F.col("TN"), F.col("TN") + F.col("FP"))})


def mistakes(samples: DataFrame) -> DataFrame:
    """Samples whose label contradicts the prediction, false positives and false negatives."""
    kind = F.when((F.col("IN_NEST") == 1) & (F.col("MANUAL_QC") == 0), "FP").when((F.col("IN_NEST") == 0) & (F.col("MANUAL_QC") == 1), "FN")
    return samples.withColumn("kind", kind).filter("kind is not null").select("kind", "sample_id", "screenshot")


def excluded(rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """Frames in all, those of the pool, and the others; rows are frames or ranges of frames."""
    n = lambda df: F.coalesce(F.sum(sizes(df)), F.lit(0)).cast("long")
    return rows.agg(n(rows).alias("total")).join(eligible.agg(n(eligible).alias("eligible")), how="cross").withColumn("excluded", F.col("total") - F.col("eligible"))


def latest(log: DataFrame, key: str = "sample_id", order: str = "seq", value: str = "label") -> DataFrame:
    """The last entry of each key of a log of labels; what an update in place would have left."""
    return log.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("writes"))
