"""The log of a review session: answers, undo, redo; replayed in a batch or kept up to date as a stream.

A log has session, seq, kind (ANSWER, UNDO, REDO), gap, answer and token. The
effective log of a session is a stack: an answer clears what could be redone,
undo moves the last answer there, redo moves it back. An event whose token is
not the session's present one came too late and is dropped; a null token is
always current. The token rises with each event that has an effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "session long, seq long, kind string, gap long, answer int, token long"
EFFECTIVE = "session long, position long, seq long, gap long, answer int"


class Session:
    """A session's stacks."""

    def __init__(self, done: list | None = None, undone: list | None = None, token: int = 0) -> None:
        self.done, self.undone, self.token = done or [], undone or [], token

    def apply(self, seq: int, kind: str, gap: int | None, answer: int | None, token: int | None) -> bool:
        """Whether the event had an effect."""
        if token is not None and token != self.token:
            return False
        if kind == "ANSWER":
            self.done.append((seq, gap, answer))
            self.undone.clear()
        elif kind == "UNDO" and self.done:
            self.undone.append(self.done.pop())
        elif kind == "REDO" and self.undone:
            self.done.append(self.undone.pop())
        else:
            return False
        self.token += 1
        return True


def events_as_log(events: DataFrame) -> DataFrame:
    """Sessions made of users' events; some tokens are stale."""
    kind = F.when(F.col("event_type") == "error", "UNDO").when(F.col("event_id") % 7 == 0, "REDO").otherwise("ANSWER")
    token = F.when(F.col("event_id") % 11 == 0, F.lit(-1)).cast("long")
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 50).alias("gap"), (F.col("event_id") % 3 - 1).cast("int").alias("answer"), token.alias("token"))


def _clean(x):
    return None if x is None or x != x else int(x)


def replay(log: DataFrame) -> DataFrame:
    """The effective answers of each session, in order. Sessions are read in order of their events, one at a time, as a stream of batches."""
    ordered = log.select("session", "seq", "kind", "gap", "answer", "token").repartition("session").sortWithinPartitions("session", "seq")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Session()

        def result() -> pa.RecordBatch:
            rows = [(now, k, *x) for k, x in enumerate(state.done, 1)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["session", "position", "seq", "gap", "answer"])

        for batch in batches:
            for session, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if session != now:
                    if state.done:
                        yield result()
                    now, state = session, Session()
                state.apply(*event)
        if state.done:
            yield result()

    return ordered.mapInArrow(work, EFFECTIVE)


class Replay(StatefulProcessor):
    """A session's stacks as maps from position to entry, and their sizes: an event reads and writes the entries it moves, whatever the stacks hold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sizes = handle.getValueState("sizes", "done long, undone long, token long")
        self.done = handle.getMapState("done", "position long", "seq long, gap long, answer int")
        self.undone = handle.getMapState("undone", "position long", "seq long, gap long, answer int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, undone, token = self.sizes.get() if self.sizes.exists() else (0, 0, 0)
        changed = set()
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if (current := _clean(row.token)) is not None and current != token:
                continue
            if row.kind == "ANSWER":
                done += 1
                self.done.updateValue((done,), (int(row.seq), _clean(row.gap), _clean(row.answer)))
                for position in range(1, undone + 1):
                    self.undone.removeKey((position,))
                undone = 0
                changed.add(done)
            elif row.kind == "UNDO" and done:
                undone += 1
                self.undone.updateValue((undone,), tuple(self.done.getValue((done,))))
                self.done.removeKey((done,))
                changed.add(done)
                done -= 1
            elif row.kind == "REDO" and undone:
                done += 1
                self.done.updateValue((done,), tuple(self.undone.getValue((undone,))))
                self.undone.removeKey((undone,))
                undone -= 1
                changed.add(done)
            else:
                continue
            token += 1
        self.sizes.update((done, undone, token))
        told = [(key[0], p, *(tuple(self.done.getValue((p,))) if p <= done else (None, None, None))) for p in sorted(changed)]
        yield pd.DataFrame(told, columns=["session", "position", "seq", "gap", "answer"]).astype("Int64")

    def close(self) -> None:
        pass


def stream(log: DataFrame) -> DataFrame:
    """The same as a streaming query that emits changes: the answer that now stands at a session's position, or nulls if none does any more.

    State is kept in RocksDB, an entry at a time; events of a batch are applied
    in order of seq. A sink that keeps the last row of each (session, position)
    holds the effective answers.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return log.groupBy("session").transformWithStateInPandas(Replay(), EFFECTIVE, "update", "none")


def review_seconds(log: DataFrame) -> DataFrame:
    """Seconds spent on each gap in its first visit, from a log with timestamps (ts): a visit ends when another gap is answered."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("seq")
    visit = F.sum(F.coalesce((F.col("gap") != F.lag("gap").over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    visits = log.withColumn("visit", visit).groupBy("session", "gap", "visit").agg((F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("duration_sec"))
    return visits.groupBy("session", "gap").agg(F.min_by("duration_sec", "visit").alias("duration_sec"))
