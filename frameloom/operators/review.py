"""Review of open gaps: a state machine per gap, folded over its answers in one expression.

A gap has at most one live segment, so its state is (type, first, last) and
what is decided so far. Gaps with checkpoints show a segment's last frame, all
others the middle one. Nothing is shuffled and no gap is expanded to frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, GAP_TYPES, Config
from .gaps import source_of

_SEGMENT = "struct<seg_start:bigint,seg_end:bigint,value:bigint>"
_STATE = f"struct<t:string,s:bigint,e:bigint,segs:array<{_SEGMENT}>,open:boolean>"


def shown(t: Column, s: Column, e: Column) -> Column:
    """The frame that a reviewer is asked about."""
    return F.when(t == "00", e).otherwise(F.floor((s + e) / 2).cast("long"))


def _step(state: Column, answer: Callable[[Column], Column], last: Column, c: Config) -> Column:
    def given(z: Column) -> Column:
        t, s, e, m, a = (state["t"], state["s"], state["e"], z["m"], z["a"])
        whole = (a == -1) | (t == "00") | (e - s + 1 <= c.short_segment)
        left = ((t == "10") & (a == 1)) | ((t == "01") & (a == 0))  # the part up to the middle has the answer
        first = F.when(whole | left, s).otherwise(m)
        past = F.when(~whole & left, m).otherwise(e)
        next_checkpoint = (t == "00") & (a != 1)
        hands_off = (t == "00") & (a == 1)
        done = whole & (t != "00")
        s2 = F.when(done, F.lit(1)).when(next_checkpoint | hands_off, e + 1).when(left, m + 1).otherwise(s)
        e2 = F.when(done, F.lit(0)).when(next_checkpoint, F.least(e + c.checkpoint, last)).when(hands_off, last).when(left, e).otherwise(m - 1)
        t2 = F.when(hands_off, F.lit("10")).otherwise(t)
        segs = F.concat(state["segs"], F.array(F.struct(first.alias("seg_start"), past.alias("seg_end"), a.alias("value"))))
        return F.struct(t2.alias("t"), s2.cast("long").alias("s"), e2.cast("long").alias("e"), segs.alias("segs"), F.lit(False).alias("open")).cast(_STATE)

    m = shown(state["t"], state["s"], state["e"])
    asked = F.transform(F.array(F.struct(m.alias("m"), answer(m).cast("long").alias("a"))), given_or_open(given, state))[0]
    return F.when((state["s"] > state["e"]) | state["open"], state).otherwise(asked)


def given_or_open(given: Callable[[Column], Column], state: Column) -> Callable[[Column], Column]:
    """A frame without an answer leaves the segment open."""
    waits = lambda: F.struct(state["t"], state["s"], state["e"], state["segs"], F.lit(True)).cast(_STATE)
    return lambda z: F.when(z["a"].isNull(), waits()).otherwise(given(z))


def resolve(g: DataFrame, answer: Callable[[Column], Column], c: Config = DEFAULT) -> DataFrame:
    """Reviewed gaps with the state after all answers; `answer` maps a frame column to 1, 0, -1 (cannot judge) or null (none yet)."""
    return g.filter("route in ('checkpoints', 'bisect')").withColumn("state", fold(answer, c))


def fold(answer: Callable[[Column], Column], c: Config = DEFAULT) -> Column:
    """The state of a gap's review after all answers; a gap of an unknown type is an error."""
    last = F.col("GAP_END_FRAME") - 1
    first = F.col("GAP_START_FRAME") + 1
    # Only of rows under review: Spark may evaluate this before a filter that drops the others.
    wrong = F.raise_error(F.concat(F.lit("unknown gap type "), F.coalesce("gap_type", F.lit("null")))).cast("string")
    known = F.when(F.col("gap_type").isin(*GAP_TYPES), F.col("gap_type")).when((F.col("size") > 0) & F.col("route").isin("checkpoints", "bisect"), wrong).otherwise(F.lit("00"))
    start = F.struct(known.alias("t"), first.alias("s"), F.when(F.col("gap_type") == "00", F.least(first + c.checkpoint - 1, last)).otherwise(last).alias("e"), F.array().cast(f"array<{_SEGMENT}>").alias("segs"), F.lit(False).alias("open")).cast(_STATE)
    # As many steps as a gap between absences has checkpoints, and those of a bisection, which at least halves what is left, down to a short segment; one more is to spare.
    halvings = F.ceil(F.log2(F.greatest(F.col("size") / float(max(1, c.short_segment)), F.lit(1.0)))) + 2
    steps = F.sequence(F.lit(1), (F.when(F.col("gap_type") == "00", F.floor((F.col("size") - 1) / c.checkpoint) + 1).otherwise(F.lit(0)) + halvings).cast("int"))
    return F.aggregate(steps, start, lambda state, _: _step(state, answer, last, c))


def answers_map(g: DataFrame, answers: DataFrame) -> DataFrame:
    """Reviewed gaps with the answers (ANIMALID, FRAMENUMBER, answer) that fall into them, as a map.

    Of several answers for one frame the one with the greatest seq counts, a column that a
    table without such frames need not have; without it the greatest answer. Answers are matched to gaps by slices of frames, an equi-join; a gap has
    few answers, so its map is small.
    """
    width = 1 << 16
    spans = g.withColumn("_slice", F.explode(F.sequence(F.floor(F.col("GAP_START_FRAME") / width), F.floor(F.col("GAP_END_FRAME") / width))))
    latest = F.max_by("answer", "seq") if "seq" in answers.columns else F.max("answer")
    answers = answers.groupBy("ANIMALID", "FRAMENUMBER").agg(latest.alias("answer"))
    given = answers.select(F.col("ANIMALID").alias("_a"), F.col("FRAMENUMBER").alias("_f"), F.col("answer").cast("long").alias("_v"), F.floor(F.col("FRAMENUMBER") / width).alias("_s"))
    inside = (F.col("_a") == F.col("ANIMALID")) & (F.col("_s") == F.col("_slice")) & (F.col("_f") > F.col("GAP_START_FRAME")) & (F.col("_f") < F.col("GAP_END_FRAME"))
    maps = spans.join(given, inside).groupBy("ANIMALID", "GAP_START_FRAME").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("_f", "_v")))).alias("answers"))
    return g.join(maps, ["ANIMALID", "GAP_START_FRAME"], "left")


def segments(g: DataFrame, answer: Callable[[Column], Column], c: Config = DEFAULT) -> DataFrame:
    """The decided ranges of reviewed gaps."""
    done = resolve(g, answer, c)
    return done.select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "gap_type", F.inline("state.segs"))


def unresolved(g: DataFrame, answer: Callable[[Column], Column], c: Config = DEFAULT) -> DataFrame:
    """Reviewed gaps that still wait for an answer, and the frame to show."""
    s = F.col("state")
    return resolve(g, answer, c).filter("state.open").select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", shown(s["t"], s["s"], s["e"]).alias("show_frame"))


def all_segments(g: DataFrame, answer: Callable[[Column], Column], c: Config = DEFAULT) -> DataFrame:
    """The ranges that tile all gaps: by rule, not reviewed, and reviewed; with their source. Frames without an answer are an error."""
    rows = g.withColumn("segs", decided(answer, c)).select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "gap_type", "route", F.inline("segs"))
    return rows.withColumn("source", source_of(F.col("value"), F.col("route").isin("checkpoints", "bisect")))


def decided(answer: Callable[[Column], Column], c: Config = DEFAULT) -> Column:
    """The ranges that tile a gap, in one expression over a row of gaps.gaps: the fold of its review, or the whole gap with its value by rule."""
    waits = F.raise_error(F.lit("a reviewed gap has frames without an answer")).cast(f"array<{_SEGMENT}>")
    state = fold(answer, c)
    whole = F.array(F.struct((F.col("GAP_START_FRAME") + 1).alias("seg_start"), (F.col("GAP_END_FRAME") - 1).alias("seg_end"), F.col("fill").cast("long").alias("value"))).cast(f"array<{_SEGMENT}>")
    reviewed = F.transform(F.array(state), lambda s: F.when(s["open"], waits).otherwise(s["segs"]))[0]
    return F.when(F.col("route").isin("checkpoints", "bisect"), reviewed).otherwise(whole)
