"""Gaps of a stream of detections: each is told at once, and taken back or split when a late detection falls into it.

State is kept per animal and holds the frames above the watermark's and the
last one below it, with their region states. A batch puts its frames among
these; where the successor of a frame has changed, the gap after it is told
anew: another end, another type, or none. Once the watermark has passed a gap's
end, nothing that may still arrive can change it: a timer tells it as final and
drops the frames that no gap needs any more.

Rows that are later than the watermark allows never reach the state; Spark
counts them (numRowsDroppedByWatermark of the query's progress).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..operators.gaps import classify, gap_type, route
from .state import use_state_store

#: The gap after a frame, or nulls if none follows (any more); version rises with each batch of the animal, and a final gap is not told again.
CHANGES = "ANIMALID long, GAP_START_FRAME long, GAP_END_FRAME long, before int, after int, after_in_buffer boolean, final boolean, version long"
_FRAME = "frame long, state int, in_buffer boolean, data long, agree boolean, ms long"


class Gaps(StatefulProcessor):
    """One animal: `window`, its frames in order, and `version`, how often it has told something."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", _FRAME)
        self.version = handle.getValueState("version", "version long")

    def _told(self, animal: int, starts: dict[int, tuple | None], final: bool) -> Iterator[Row]:
        (version,) = self.version.get() if self.version.exists() else (0,)
        version += 1
        self.version.update((version,))
        make = Row("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "before", "after", "after_in_buffer", "final", "version")
        for start, gap in sorted(starts.items()):
            yield make(animal, start, *(gap or (None, None, None, None)), final, version)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = {r[0]: tuple(r) for r in self.window.get()} if self.window.exists() else {}
        new = dict(old)
        for r in rows:
            have = new.get(r["frame"])
            # Equal rows of a frame are one detection; a frame whose rows disagree is none, but stays known as such.
            agree = have is None or (have[4] and have[3] == r["data"])
            new[r["frame"]] = (r["frame"], r["state"], r["in_buffer"], r["data"], agree, max(r["ms"], have[5] if have else r["ms"]))
        self.window.put([new[f] for f in sorted(new)])
        before, after = _gaps(old), _gaps(new)
        changed = {s: after.get(s) for s in before.keys() | after.keys() if before.get(s) != after.get(s)}
        if timerValues.getCurrentWatermarkInMs() >= 0:  # a stream with a watermark, not a table
            self.handle.registerTimer(max(r[5] for r in new.values()) + 1)
        if changed:
            yield from self._told(key[0], changed, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All up to the watermark is settled: gaps that end there are final, and of their frames the last is kept as the start of the next."""
        now = timerValues.getCurrentWatermarkInMs()
        frames = [tuple(r) for r in self.window.get()] if self.window.exists() else []
        settled = _settled(frames, now)
        if settled is None:
            return
        known = {f[0]: f for f in frames}
        final = {s: g for s, g in _gaps(known).items() if g[0] <= settled}
        self.window.put([f for f in frames if f[0] >= settled])
        if final:
            yield from self._told(key[0], final, True)

    def close(self) -> None:
        pass


def _gaps(frames: dict[int, tuple]) -> dict[int, tuple]:
    """The gap after each frame that has one: end, states on either side."""
    use = sorted(f for f, r in frames.items() if r[4])
    return {p: (q, frames[p][1], frames[q][1], frames[q][2]) for p, q in zip(use, use[1:]) if q - p > 1}


def _settled(frames: list[tuple], watermark_ms: int) -> int | None:
    """The last detection that the watermark has passed: as frames rise with time, nothing below it can still arrive."""
    return max((f[0] for f in frames if f[4] and f[5] <= watermark_ms), default=None)


def changes(detections: DataFrame, time: str | None = "ts", lateness: str = "1 day", c: Config = DEFAULT) -> DataFrame:
    """Changes (CHANGES) of the gaps of a stream of detections (ANIMALID, FRAMENUMBER, MASS_X, MASS_Y, a time, and columns that copies must share).

    Frames rise with time. Detections without animal or frame are left out. With `time` None the rows are a table, of which all gaps are told at once.
    """
    use_state_store(detections.sparkSession)
    data = [x for x in detections.columns if x not in ("ANIMALID", "FRAMENUMBER", "_rowid", time)]
    rows = classify(detections.filter("ANIMALID is not null and FRAMENUMBER is not null").withColumn("data", F.xxhash64(*data)), c)
    ms = F.unix_millis(F.col(time).cast("timestamp")) if time else F.lit(0).cast("long")
    out = rows.select("ANIMALID", F.col("FRAMENUMBER").cast("long").alias("frame"), F.col("IN_NEST").alias("state"), "in_buffer", "data", ms.alias("ms"), *([F.col(time).cast("timestamp").alias("_time")] if time else []))
    if time:
        out = out.withWatermark("_time", lateness)
    return out.groupBy("ANIMALID").transformWithState(Gaps(), CHANGES, "update", "eventTime" if time else "none")


def current(told: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The gaps that stand after some changes, as gaps.gaps gives them."""
    last = told.groupBy("ANIMALID", "GAP_START_FRAME").agg(F.max_by(F.struct("GAP_END_FRAME", "before", "after", "after_in_buffer"), "version").alias("g"))
    g = last.select("ANIMALID", "GAP_START_FRAME", "g.*").filter("GAP_END_FRAME is not null")
    fill = F.when((F.col("before") == 1) & F.col("after_in_buffer"), 1).otherwise(-1)
    g = g.withColumns({"size": F.col("GAP_END_FRAME") - F.col("GAP_START_FRAME") - 1, "gap_type": gap_type(F.col("before"), F.col("after")), "fill": fill})
    return g.select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "size", "gap_type", "fill", route(c).alias("route"))
