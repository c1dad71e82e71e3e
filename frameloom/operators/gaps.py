"""From detections to gaps, their fill by rule, their types and routes, and per-frame timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ASSUMED, BINARY_SEARCH, DEFAULT, DETECTED, GAP_TYPES, LOGIC, UNKNOWN, Config
from ..functions.scalars import in_region

#: Frames of one slice: no animal's detections are sorted as a whole.
SLICE = 1 << 20


def classify(detections: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Detections with IN_NEST (0 or 1) and in_buffer."""
    x, y = F.col("MASS_X"), F.col("MASS_Y")
    return detections.withColumn("IN_NEST", in_region(c.nest, x, y).cast("int")).withColumn("in_buffer", in_region(c.buffer, x, y))


def counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("ANIMALID").agg(F.count("*").alias("detected"), F.sum("IN_NEST").cast("long").alias("detected_in"), F.sum(1 - F.col("IN_NEST")).cast("long").alias("detected_out"))


def nexts(detections: DataFrame, carry: list[str], slice_frames: int = SLICE) -> DataFrame:
    """Each detection with the next one's frame and carried columns (prefix next_); null for an animal's last.

    Detections are sorted within slices of an animal's frames, so an animal with
    very many of them is spread over many tasks. Only the last row of a slice
    looks beyond it, for the first row of the next slice that has any: these
    rows, one per slice, are ordered by themselves. Rows that share a frame are
    in the order of the carried columns; of those that share these too any may be the last.
    """
    row = F.struct("FRAMENUMBER", *carry)
    rows = detections.withColumn("_slice", F.floor(F.col("FRAMENUMBER") / F.lit(slice_frames)))
    inside = Window.partitionBy("ANIMALID", "_slice").orderBy("FRAMENUMBER", *carry)
    across = Window.partitionBy("ANIMALID").orderBy("_slice")
    known = rows.withColumns({"_next": F.lead(row).over(inside), "_head": F.first(row).over(inside)})
    last = known.filter("_next is null").withColumn("_next", F.lead("_head").over(across))
    found = known.filter("_next is not null").unionByName(last)
    return found.select(*detections.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in ("FRAMENUMBER", *carry)])


def pairs(detections: DataFrame, carry: list[str], slice_frames: int = SLICE) -> DataFrame:
    """Each detection but an animal's last with the next one's frame and carried columns (prefix next_)."""
    return nexts(detections, carry, slice_frames).filter("next_FRAMENUMBER is not null")


def nonincreasing(detections: DataFrame, limit: int = 10) -> DataFrame:
    """Pairs of successive detections whose frame does not rise, the first few: the rows that a guard rejects."""
    return pairs(detections, []).filter("next_FRAMENUMBER <= FRAMENUMBER").groupBy("ANIMALID", "FRAMENUMBER").agg(F.count("*").alias("repeats")).orderBy("ANIMALID", "FRAMENUMBER").limit(limit)


def require_increasing(detections: DataFrame) -> DataFrame:
    """The detections, or an error that names some offenders (null frames too)."""
    if detections.filter("FRAMENUMBER is null").limit(1).count():
        raise ValueError("detections without a frame number")
    if bad := nonincreasing(detections).collect():
        raise ValueError(f"duplicate or non-increasing frames: {[(r['ANIMALID'], r['FRAMENUMBER']) for r in bad]}")
    return detections


def gap_type(before: Column, after: Column) -> Column:
    """Two digits, the states on either side; null unless both are 0 or 1."""
    return F.when(before.isin(0, 1) & after.isin(0, 1), F.concat(before.cast("string"), after.cast("string")))


def require_types(g: DataFrame) -> DataFrame:
    """The gaps, or an error if a boundary is missing or not classified as 0 or 1, or if a type is none of the four.

    An error raised inside an expression could be raised for rows that a
    filter drops, as filters may be evaluated in any order.
    """
    if bad := g.filter(F.col("gap_type").isNull() | ~F.col("gap_type").isin(*GAP_TYPES)).select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME").limit(10).collect():
        raise ValueError(f"gaps without a type: {[tuple(r) for r in bad]}")
    return g


def with_boundaries(g: DataFrame, classified: DataFrame) -> DataFrame:
    """Gaps (ANIMALID, GAP_START_FRAME, GAP_END_FRAME) of any table with the type that their boundary frames' states give; null if a frame is not there."""
    state = lambda n, c: classified.select("ANIMALID", F.col("FRAMENUMBER").alias(n), F.col("IN_NEST").alias(c))
    both = g.join(state("GAP_START_FRAME", "_b"), ["ANIMALID", "GAP_START_FRAME"], "left").join(state("GAP_END_FRAME", "_e"), ["ANIMALID", "GAP_END_FRAME"], "left")
    return both.select(*g.columns, gap_type(F.col("_b"), F.col("_e")).alias("gap_type"))


def states_asof(g: DataFrame, classified: DataFrame, slice_frames: int = SLICE) -> DataFrame:
    """Gaps of any table with state_before, that of the last detection at or before GAP_START_FRAME (the animal's first, if none is), and state_after, likewise after GAP_END_FRAME.

    Detections and bounds are merged in order within slices of frames; what a
    slice does not hold comes from the states that one aggregate per slice carries along.
    """
    sliced = lambda df: df.withColumn("_slice", F.floor(F.col("_frame") / F.lit(slice_frames)))
    det = sliced(classified.select("ANIMALID", F.col("FRAMENUMBER").alias("_frame"), F.col("IN_NEST").alias("_state")))
    none = F.lit(None)
    bound = lambda c, side: g.select("ANIMALID", F.col(c).alias("_frame"), none.cast("int").alias("_state"), "GAP_START_FRAME", "GAP_END_FRAME", F.lit(side).alias("_side"))
    asked = sliced(bound("GAP_START_FRAME", 0).unionByName(bound("GAP_END_FRAME", 1)))
    own = Window.partitionBy("ANIMALID", "_slice").orderBy("_frame", F.col("_state").isNull())
    back = Window.partitionBy("ANIMALID", "_slice").orderBy(F.desc("_frame"), F.col("_state").isNull())
    merged = det.unionByName(asked, allowMissingColumns=True)
    merged = merged.withColumn("_before", F.last("_state", ignorenulls=True).over(own)).withColumn("_after", F.last("_state", ignorenulls=True).over(back)).filter("_side is not null")
    ends = det.groupBy("ANIMALID", "_slice").agg(F.min_by("_state", "_frame").alias("_first"), F.max_by("_state", "_frame").alias("_last"))
    slices = ends.select("ANIMALID", "_slice").union(asked.select("ANIMALID", "_slice")).distinct().join(ends, ["ANIMALID", "_slice"], "left")
    along = Window.partitionBy("ANIMALID").orderBy("_slice")
    up, down = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy("ANIMALID").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = slices.select("ANIMALID", "_slice", F.coalesce(F.last("_last", ignorenulls=True).over(up), F.first("_first", ignorenulls=True).over(every)).alias("_earlier"), F.coalesce(F.first("_first", ignorenulls=True).over(down), F.last("_last", ignorenulls=True).over(every)).alias("_later"))
    told = merged.join(carried, ["ANIMALID", "_slice"], "left").groupBy("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME")
    return told.agg(F.max(F.when(F.col("_side") == 0, F.coalesce("_before", "_earlier"))).alias("state_before"), F.max(F.when(F.col("_side") == 1, F.coalesce("_after", "_later"))).alias("state_after"))


def gaps(classified: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """A row per gap: its last frame before and first after, missing frames, type, value by rule (1 or -1) and route.

    Boundary states come with the pair, so no join looks them up. A gap is
    filled with 1 if it starts in the nest and ends in the buffer, else with -1
    and goes by its type and size.
    """
    return with_gaps(classified, c).filter("size > 0").select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "size", "gap_type", "fill", "route")


def with_gaps(classified: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Every detection (ANIMALID, FRAMENUMBER, IN_NEST) with the gap after it, whose size is 0 where there is none: what counts both needs no second pass."""
    p = nexts(classified, ["IN_NEST", "in_buffer"])
    size = F.coalesce(F.col("next_FRAMENUMBER") - F.col("FRAMENUMBER") - 1, F.lit(0))
    fill = F.when((F.col("IN_NEST") == 1) & F.col("next_in_buffer"), 1).otherwise(-1)
    g = p.select("ANIMALID", "FRAMENUMBER", "IN_NEST", F.col("FRAMENUMBER").alias("GAP_START_FRAME"), F.col("next_FRAMENUMBER").alias("GAP_END_FRAME"), size.alias("size"), gap_type(F.col("IN_NEST"), F.col("next_IN_NEST")).alias("gap_type"), fill.alias("fill"))
    return g.withColumn("route", F.when(F.col("size") > 0, route(c)))


def route(c: Config = DEFAULT) -> Column:
    short = F.col("size") <= c.short_gap
    return (
        F.when(F.col("fill") == 1, "logic")
        .when((F.col("gap_type") == "00") & short, "short_00")
        .when(F.col("gap_type") == "00", "checkpoints")
        .when(F.col("gap_type") == "11", "type_11")
        .when(short, "short")
        .otherwise("bisect")
    )


def numbered(g: DataFrame) -> DataFrame:
    """The gaps that rules leave open with gap_index and total_gaps; those that are not reviewed count too."""
    w = Window.partitionBy("ANIMALID").orderBy("GAP_START_FRAME", "GAP_END_FRAME")
    return g.filter("fill = -1").withColumn("gap_index", F.row_number().over(w)).withColumn("total_gaps", F.count("*").over(Window.partitionBy("ANIMALID")))


def checkpoints(g: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The segments that tile each reviewed gap between two absences; each is shown by its last frame."""
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / c.checkpoint)))
    rows = g.filter("route = 'checkpoints'").select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", k.alias("k"))
    first = F.col("GAP_START_FRAME") + 1 + F.col("k") * c.checkpoint
    return rows.select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "k", first.alias("seg_start"), F.least(first + c.checkpoint - 1, F.col("GAP_END_FRAME") - 1).alias("seg_end"))


def filled(g: DataFrame) -> DataFrame:
    """Every missing frame of the gaps with the value by rule; only here are gaps expanded."""
    frames = g.filter("size >= 1").withColumn("FRAMENUMBER", F.explode(F.sequence(F.col("GAP_START_FRAME") + 1, F.col("GAP_END_FRAME") - 1)))
    return frames.select("ANIMALID", "FRAMENUMBER", F.col("fill").alias("IN_NEST"), F.lit(ASSUMED).alias("ASSUMPTION_TYPE"), "GAP_START_FRAME", "GAP_END_FRAME")


def detected_rows(classified: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return classified.select("ANIMALID", "FRAMENUMBER", "IN_NEST", F.lit(DETECTED).alias("ASSUMPTION_TYPE"), none.alias("GAP_START_FRAME"), none.alias("GAP_END_FRAME"))


def timeline(classified: DataFrame, g: DataFrame) -> DataFrame:
    return detected_rows(classified).unionByName(filled(g))


def ranges(classified: DataFrame, segments: DataFrame) -> DataFrame:
    """The timeline after review as ranges of frames (first_frame, last_frame) with FILL_SOURCE: one of each detection, and the decided ranges of all gaps."""
    assumed = segments.select("ANIMALID", F.col("seg_start").alias("first_frame"), F.col("seg_end").alias("last_frame"), F.col("value").cast("int").alias("IN_NEST"), F.lit(ASSUMED).alias("ASSUMPTION_TYPE"), "GAP_START_FRAME", "GAP_END_FRAME", F.col("source").alias("FILL_SOURCE"))
    found = detected_rows(classified).withColumn("FILL_SOURCE", F.lit(DETECTED))
    return found.select("ANIMALID", F.col("FRAMENUMBER").alias("first_frame"), F.col("FRAMENUMBER").alias("last_frame"), *found.columns[2:]).unionByName(assumed)


def rule_ranges(classified: DataFrame, g: DataFrame) -> DataFrame:
    """The timeline before review as ranges of frames: one of each detection, and each gap with its value by rule."""
    whole = g.select(*g.columns, (F.col("GAP_START_FRAME") + 1).alias("seg_start"), (F.col("GAP_END_FRAME") - 1).alias("seg_end"), F.col("fill").alias("value"), F.lit(None).cast("string").alias("source"))
    return ranges(classified, whole).drop("FILL_SOURCE")


def frames(of_ranges: DataFrame) -> DataFrame:
    """A row per frame of each range."""
    rest = [c for c in of_ranges.columns if c not in ("ANIMALID", "first_frame", "last_frame")]
    return of_ranges.select("ANIMALID", F.explode(F.sequence("first_frame", "last_frame")).alias("FRAMENUMBER"), *rest)


def final_timeline(classified: DataFrame, segments: DataFrame) -> DataFrame:
    """Every frame after review, with FILL_SOURCE; segments are the decided ranges of all gaps."""
    return frames(ranges(classified, segments))


def source_of(value: Column, reviewed: Column) -> Column:
    return F.when(reviewed, BINARY_SEARCH).when(value == -1, UNKNOWN).otherwise(LOGIC)
