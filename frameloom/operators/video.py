"""Which video shows a frame: exact cover, else the nearest available frame on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..config import DEFAULT, Config
from ..functions.scalars import local_frame, start_frame
from .slices import SLICE, with_slice

#: Frames of a slice in which frames and ranges are merged, and rows of one part of it.
TILE, PART_ROWS = 1 << 12, 1 << 20


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def video_map(files: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """start, end (past the last), path and frame_count of the files whose name tells a frame."""
    start = start_frame(name_of(F.col("path")))
    return files.withColumn("start", start).filter("start is not null").select("start", (F.col("start") + F.col("frame_count") * c.frame_conversion).alias("end"), "path", "frame_count", "fps")


def rejects(files: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """name and reason: no frame number, or another frame rate than expected (such a video is used all the same)."""
    name = name_of(F.col("path"))
    reason = F.when(start_frame(name).isNull(), "unparseable").when((F.col("fps") > 0) & (F.abs(F.col("fps") - c.video_fps) > c.fps_tolerance), "fps mismatch")
    return files.select(name.alias("name"), reason.alias("reason")).filter("reason is not null")


_VIDEO = ("start", "end", "path", "frame_count", "readable")


def shown_ranges(videos: DataFrame, slice_frames: int = SLICE) -> DataFrame:
    """Ranges [first, past) that tile all frames, null for no bound, with the video that covers them, or the ones before and after a hole.

    In order of their starts, a video is the first that covers what no earlier
    one reaches: from the greatest end so far to its own. What lies between
    that end and its start is a hole. The greatest end so far is a running value within slices
    of starts, carried from slice to slice.
    """
    readable = F.col("readable") if "readable" in videos.columns else F.lit(True).alias("readable")
    v = F.struct(*_VIDEO)
    # The greatest end, of equal ones that of the first start: as the least of its negative.
    reach = F.struct((-F.col("end")).alias("to"), "start", "path", v.alias("v"))
    rows = with_slice(videos.select(*_VIDEO[:-1], readable).filter("start is not null"), "start", slice_frames).withColumn("_reach", reach)
    before = Window.partitionBy("_slice").orderBy("start", "path", "end").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    slices = rows.groupBy("_slice").agg(F.min("_reach").alias("_all")).select("_slice", F.min("_all").over(along).alias("_carried"))
    met = rows.withColumn("_own", F.min("_reach").over(before)).join(slices, "_slice").withColumn("_last", F.least("_own", "_carried"))
    reached, none = -F.col("_last.to"), F.lit(None).cast(rows.select(v.alias("v")).schema["v"].dataType)
    piece = lambda first, past, inside, last, after: F.struct(first.alias("first"), past.alias("past"), inside.alias("inside"), last.alias("before"), after.alias("after"))
    cover = F.when(F.col("end") > F.coalesce(reached, F.col("start")), piece(F.greatest("start", reached), F.col("end"), v, none, none))
    hole = F.when(reached.isNull() | (F.col("start") > reached), piece(reached, F.col("start"), none, F.col("_last.v"), v))
    tiles = met.select(F.inline(F.array_compact(F.array(hole, cover))))
    rest = rows.agg(F.min("_reach").alias("_last")).select(F.inline(F.array(piece(reached, F.lit(None).cast("long"), none, F.col("_last.v"), none))))
    return tiles.unionByName(rest)


def candidates(frames: DataFrame, videos: DataFrame, c: Config = DEFAULT, slice_frames: int = TILE) -> DataFrame:
    """Per (ANIMALID, FRAMENUMBER) one or two rows: candidate_rank, resolved, path, start, frame_count, readable.

    The video that covers a frame is the one with the least start among those
    that do, the nearest ones are the last end before and the first start
    after. Ranges are cut at slices of frames and merged with the frames of
    their slice in order; a slice that many animals share is dealt by animal,
    each part with the slice's ranges.
    """
    asked = frames.select("ANIMALID", "FRAMENUMBER").filter("FRAMENUMBER is not null")
    ends = asked.agg(F.min("FRAMENUMBER").alias("lo"), F.max("FRAMENUMBER").alias("hi"), F.count("*").alias("n")).first()
    low, high = (ends["lo"] or 0) // slice_frames, (ends["hi"] or 0) // slice_frames
    deals = max(1, -(-ends["n"] // ((high - low + 1) * PART_ROWS)))
    first, last = F.greatest(F.floor(F.col("first") / slice_frames), F.lit(low)), F.least(F.floor((F.col("past") - 1) / slice_frames), F.lit(high))
    tiles = shown_ranges(videos).withColumns({"_a": F.coalesce(first, F.lit(low)), "_b": F.coalesce(last, F.lit(high))}).filter("_a <= _b")
    tiles = tiles.withColumn("_slice", F.explode(F.sequence("_a", "_b"))).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    told = F.struct("inside", "before", "after")
    tiles = tiles.select("_slice", "_deal", F.greatest(F.coalesce("first", F.col("_slice") * slice_frames), F.col("_slice") * slice_frames).alias("_at"), told.alias("_told"))
    rows = asked.select(F.floor(F.col("FRAMENUMBER") / slice_frames).alias("_slice"), F.pmod(F.hash("ANIMALID"), F.lit(deals)).alias("_deal"), F.col("FRAMENUMBER").alias("_at"), "ANIMALID", "FRAMENUMBER")
    order = Window.partitionBy("_slice", "_deal").orderBy("_at", F.col("_told").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.unionByName(tiles, allowMissingColumns=True).withColumn("_v", F.last("_told", ignorenulls=True).over(order)).filter("FRAMENUMBER is not null").select("ANIMALID", "FRAMENUMBER", "_v.*")
    frame = F.col("FRAMENUMBER")
    pick = lambda v, at: F.when(F.col(v).isNotNull(), F.struct(at.cast("long").alias("resolved"), *[F.col(f"{v}.{x}").alias(x) for x in ("path", "start", "frame_count", "readable")]))
    here, back, ahead = pick("inside", frame), pick("before", F.col("before.end") - c.frame_conversion), pick("after", F.col("after.start"))
    later = frame - (F.col("before.end") - c.frame_conversion) > F.col("after.start") - frame
    options = F.array_compact(F.when(F.col("inside").isNotNull(), F.array(here)).when(later, F.array(ahead, back)).otherwise(F.array(back, ahead)))
    return joined.select("ANIMALID", "FRAMENUMBER", F.posexplode(options).alias("_k", "_v")).select("ANIMALID", "FRAMENUMBER", (F.col("_k") + 1).alias("candidate_rank"), "_v.*")


def marked(videos: DataFrame, unreadable: DataFrame) -> DataFrame:
    """The videos with `readable`, false for those that a table of files that cannot be read names: by path, and by frame_count too if it has one, as recordings of different lengths may share a path."""
    keys = [c for c in ("path", "frame_count") if c in unreadable.columns]
    bad = unreadable.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct().withColumn("_bad", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return videos.join(bad, same, "left").select(*videos.columns, F.col("_bad").isNull().alias("readable"))


def resolved(frames: DataFrame, videos: DataFrame, unreadable: DataFrame | None = None, c: Config = DEFAULT) -> DataFrame:
    """The first candidate that can be read, with the frame's index in its video."""
    options = candidates(frames, videos if unreadable is None else marked(videos, unreadable), c).filter("readable")
    best = options.groupBy("ANIMALID", "FRAMENUMBER").agg(F.min(F.struct("candidate_rank", "resolved", "path", "start", "frame_count")).alias("v"))
    return best.select("ANIMALID", "FRAMENUMBER", "v.candidate_rank", "v.resolved", name_of(F.col("v.path")).alias("video"), local_frame(F.col("v.resolved"), F.col("v.start"), F.col("v.frame_count"), c).alias("local_frame"))


def samples(drawn: DataFrame, videos: DataFrame, mode: str, unreadable: DataFrame | None = None, c: Config = DEFAULT) -> DataFrame:
    """The table of samples: numbered by frame among those that a video shows, with a file name for each."""
    drawn = kept(drawn)
    rows = drawn.join(resolved(drawn, videos, unreadable, c), ["ANIMALID", "FRAMENUMBER"])
    number = F.row_number().over(Window.orderBy("ANIMALID", "FRAMENUMBER"))  # of a sample, which is small
    named = rows.withColumn("sample_id", number)
    return named.select(
        "sample_id", F.col("ANIMALID").alias("animal_id"), "video", F.col("resolved").alias("frame_global"), F.col("FRAMENUMBER").alias("requested_frame"), "IN_NEST", "ASSUMPTION_TYPE",
        F.col("FILL_SOURCE") if "FILL_SOURCE" in drawn.columns else F.lit(None).cast("string").alias("FILL_SOURCE"), "GAP_START_FRAME", "GAP_END_FRAME",
        F.format_string("S%04d_A%d_G%d_%s.png", "sample_id", "ANIMALID", "FRAMENUMBER", F.regexp_replace("video", r"\.[^.]*$", "")).alias("screenshot"),
        F.when(F.col("resolved") == F.col("FRAMENUMBER"), "exact").otherwise(F.format_string("nearest available - requested %d", "FRAMENUMBER")).alias("caption"), F.lit(mode).alias("QC_MODE"),
    )
