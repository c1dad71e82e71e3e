"""Order-dependent work in slices of an animal's frames: numbers, neighbours and runs without a window over a whole animal.

A slice is a fixed range of frames, so it holds a bounded number of rows
however long a recording is. What a slice needs from others comes from a table
with one small row per slice, along which one window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of one slice.
SLICE = 1 << 20


def with_slice(rows: DataFrame, column: str = "FRAMENUMBER", slice_frames: int = SLICE) -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col(column) / F.lit(slice_frames)))


def row_numbers(rows: DataFrame, order: str, name: str, slice_frames: int = SLICE) -> DataFrame:
    """The rows of each animal numbered from 1 by a column of frames: the place in the slice after the rows of all earlier slices."""
    sliced = with_slice(rows, order, slice_frames)
    along = Window.partitionBy("ANIMALID").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy("ANIMALID", "_slice").agg(F.count("*").alias("_n"))
    ahead = counts.select("ANIMALID", "_slice", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("ANIMALID", "_slice").orderBy(order))
    return sliced.withColumn("_place", place).join(ahead, ["ANIMALID", "_slice"]).select(*rows.columns, (F.col("_ahead") + F.col("_place")).alias(name))


def neighbours(rows: DataFrame, carry: list[str], before: int, after: int, slice_frames: int = SLICE) -> DataFrame:
    """The rows with prev_1.. and next_1..: structs of frame and carried columns of the rows around, null beyond an animal's ends.

    Each slice tells its first `after` and last `before` rows; these are the
    halo of the slices around, of which as many are looked at as rows are wanted.
    """
    row = F.struct("FRAMENUMBER", *carry)
    inside = Window.partitionBy("ANIMALID", "_slice").orderBy("FRAMENUMBER")
    width = max(before, after)
    near = {f"{side}_{k}": f(row, k).over(inside) for k in range(1, width + 1) for side, f in (("prev", F.lag), ("next", F.lead))}
    known = with_slice(rows, "FRAMENUMBER", slice_frames).withColumns(near)
    # The first and the last rows of a slice, in order: at most twice the width.
    ends = known.filter(F.col(f"prev_{width}").isNull() | F.col(f"next_{width}").isNull())
    edges = ends.groupBy("ANIMALID", "_slice").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    along = Window.partitionBy("ANIMALID").orderBy("_slice")
    halo = lambda f, n: F.flatten(F.array_compact(F.array(*[f("_rows", k).over(along) for k in n])))
    around = edges.select("ANIMALID", "_slice", halo(F.lag, range(before, 0, -1)).alias("_before"), halo(F.lead, range(1, after + 1)).alias("_after"))
    met = known.join(around, ["ANIMALID", "_slice"], "left")

    def filled(side: str, k: int) -> Column:
        """The k-th row on a side: of the slice, or of the halo where the slice has fewer."""
        have = sum((F.col(f"{side}_{i}").isNotNull().cast("int") for i in range(1, k)), F.lit(0))
        there = F.get("_after", k - 1 - have) if side == "next" else F.get("_before", F.size("_before") - k + have)
        return F.coalesce(f"{side}_{k}", there)

    sides = [("prev", k) for k in range(1, before + 1)] + [("next", k) for k in range(1, after + 1)]
    return met.select(*rows.columns, *[filled(s, k).alias(f"{s}_{k}") for s, k in sides])


def runs(pairs: DataFrame, joined: Column, slice_frames: int = SLICE) -> DataFrame:
    """ANIMALID, start_frame and pairs of the maximal runs of successive rows for which `joined` holds; null counts as false.

    Within a slice, the number of rows that break names a run. A slice's first
    run, before its first break, continues the last run of the slice before
    that has a break at all; all others start where they stand.
    """
    sliced = with_slice(pairs.withColumn("_joined", F.coalesce(joined, F.lit(False))), "FRAMENUMBER", slice_frames)
    inside = Window.partitionBy("ANIMALID", "_slice").orderBy("FRAMENUMBER").rowsBetween(Window.unboundedPreceding, 0)
    named = sliced.withColumn("_run", F.sum((~F.col("_joined")).cast("long")).over(inside))
    parts = named.groupBy("ANIMALID", "_slice", "_run").agg(F.min(F.when(F.col("_joined"), F.col("FRAMENUMBER"))).alias("start_frame"), F.count_if("_joined").alias("pairs"))
    along = Window.partitionBy("ANIMALID").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    breaks = parts.groupBy("ANIMALID", "_slice").agg(F.max("_run").alias("_breaks"))
    own = F.when(F.col("_breaks") > 0, F.struct(F.col("_slice").alias("s"), F.col("_breaks").alias("r")))
    earlier = breaks.select("ANIMALID", "_slice", F.last(own, ignorenulls=True).over(along).alias("_earlier"))
    met = parts.filter("pairs > 0").join(earlier, ["ANIMALID", "_slice"])
    chain = F.when(F.col("_run") > 0, F.struct(F.col("_slice").alias("s"), F.col("_run").alias("r"))).otherwise(F.col("_earlier"))
    return met.withColumn("_chain", chain).groupBy("ANIMALID", "_chain").agg(F.min("start_frame").alias("start_frame"), F.sum("pairs").alias("pairs")).drop("_chain")
