"""Sums over the frames of ranges, told by running sums: two lookups per range, however many frames it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A value of a frame, of a key and the frame.
Value = Callable[[Column, Column], Column]


def over_frames(ranges: DataFrame, values: dict[str, Value], period: int, key: Column | None = None, keys: int = 0) -> DataFrame:
    """The ranges (first_frame, last_frame) with the sum of each value over their frames; ranges without frames or bounds go.

    Values are whole numbers, 0 or more, that repeat after `period` frames; they may depend on a
    key from 0 to keys - 1, and are asked for a null key too. Running sums over
    one period, for every key, are broadcast: (keys + 1) * period rows, whatever the ranges hold.
    """
    spark = ranges.sparkSession
    at = spark.range((keys + 1) * period).select(F.expr(f"id div {period}").alias("_k"), F.expr(f"id % {period}").alias("_r"), F.col("id").alias("_id"))
    own = Window.partitionBy("_k")
    given = at.select("_k", "_r", "_id", *[v(F.when(F.col("_k") < keys, F.col("_k")), F.col("_r")).cast("long").alias(f"_{c}") for c, v in values.items()])
    so_far = {c: F.sum(f"_{c}").over(own.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) for c in values}
    table = given.select("_id", F.struct(*[s.alias(c) for c, s in so_far.items()]).alias("_so_far"), F.struct(*[F.sum(f"_{c}").over(own).alias(c) for c in values]).alias("_all"))
    place = F.lit(0).cast("long") if key is None else F.coalesce(key.cast("long"), F.lit(keys).cast("long"))
    before = F.col("first_frame") - 1
    turn = lambda x: F.pmod(x, F.lit(period))
    rows = ranges.filter("first_frame <= last_frame").withColumns({"_low": place * period + turn(before), "_high": place * period + turn(F.col("last_frame"))})
    rows = rows.withColumn("_turns", ((F.col("last_frame") - turn(F.col("last_frame"))) - (before - turn(before))))
    met = rows.join(F.broadcast(table.select(F.col("_id").alias("_low"), F.col("_so_far").alias("_less"))), "_low").join(F.broadcast(table.select(F.col("_id").alias("_high"), F.col("_so_far").alias("_more"), "_all")), "_high")
    summed = [(F.expr(f"_turns div {period}") * F.col(f"_all.{c}") + F.col(f"_more.{c}") - F.col(f"_less.{c}")).alias(c) for c in values]
    return met.select(*ranges.columns, *summed)
