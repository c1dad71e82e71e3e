"""A review as it happens: answers arrive as a stream, and each tells which frame to show next.

A session is one animal's review. Its state starts from the batch table of
gaps and holds one live segment (type, first, last), the queue of gaps, and a
log of inverse deltas: where the review stood before each step and the range
that the step decided. An answer or a skip adds a step, undo takes the last
one back, redo gives the answer again. A batch of events reads and writes the entries it touches,
whatever the session holds, and the same processor runs over a table or a stream.

Each frame that is shown has a token, which rises with every step, undo and
redo. An event that carries another token came for a frame that is no longer
shown and is dropped; so is an event whose seq is not above the last one, so a
source may send events again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, GAP_TYPES, Config
from ..operators.slices import row_numbers
from .state import use_state_store

#: kind is ANSWER (answer 1 in, 0 out, -1 cannot judge), SKIP, UNDO, REDO or SHOW, which only asks what is shown.
EVENTS = "session long, seq long, kind string, answer int, token long"
#: Step 0 is the segment that is shown, without a frame when nothing is left; step k the range that the k-th standing answer decided, nulls once it is taken back.
CHANGES = "session long, step long, gap_start long, gap_end long, gap_type string, seg_start long, seg_end long, value int, show_frame long, token long"
_PLACE = "place long, type string, first long, last long"
#: Gaps, steps or answers of one page.
PAGE = 64


def shown(kind: str, first: int, last: int) -> int:
    return last if kind == "00" else (first + last) // 2


def opened(start: int, end: int, kind: str, c: Config) -> tuple[str, int, int]:
    """The first segment of a gap."""
    if kind not in GAP_TYPES:
        raise ValueError(f"unknown gap type {kind!r} of the gap after frame {start}")
    return kind, start + 1, min(start + c.checkpoint, end - 1) if kind == "00" else end - 1


def answered(kind: str, first: int, last: int, end: int, answer: int, c: Config) -> tuple[int, int, tuple[str, int, int] | None]:
    """The range that an answer decides, and the gap's next segment, if it leaves one."""
    middle, rest = shown(kind, first, last), None
    if kind == "00":  # a checkpoint: absent, to the next one; present, search for the exit behind it
        rest = ("10", last + 1, end - 1) if answer == 1 else ("00", last + 1, min(last + c.checkpoint, end - 1))
        low, high = first, last
    elif answer == -1 or last - first + 1 <= c.short_segment:
        low, high = first, last
    elif (answer == 1) == (kind == "10"):  # as before the gap up to the middle
        low, high, rest = first, middle, (kind, middle + 1, last)
    else:
        low, high, rest = middle, last, (kind, first, middle - 1)
    return low, high, rest if rest and rest[1] <= rest[2] else None


class Entries:
    """A stack in a map state of pages, of which a batch of events reads and writes each once."""

    def __init__(self, state) -> None:
        self.state = state

    def open(self, n: int) -> None:
        """The stack holds n entries."""
        self.n, self.stored, self.pages, self.changed = n, n, {}, set()

    def _page(self, page: int) -> list[tuple]:
        if page not in self.pages:
            self.pages[page] = [tuple(e) for e in self.state.getValue((page,))[0]] if page * PAGE < self.stored else []
        return self.pages[page]

    def __getitem__(self, k: int) -> tuple:
        """The k-th entry, from 1."""
        page, at = divmod(k - 1, PAGE)
        return self._page(page)[at]

    def push(self, *entry) -> None:
        page, at = divmod(self.n, PAGE)
        self._page(page)[at:] = [entry]
        self.changed.add(page)
        self.n += 1

    def pop(self) -> tuple:
        entry = self[self.n]
        self.n -= 1
        self.changed.add(self.n // PAGE)
        return entry

    def clear(self) -> None:
        self.changed.update(range(-(-max(self.n, self.stored) // PAGE)))
        self.n = 0

    def save(self) -> None:
        for page in sorted(self.changed):
            if page * PAGE < self.n:
                self.state.updateValue((page,), (self._page(page)[: self.n - page * PAGE],))
            elif page * PAGE < self.stored:
                self.state.removeKey((page,))


class Live(StatefulProcessor):
    """One session: `now` where it stands, `queue` its gaps, `done` the steps that stand and `undone` the answers that redo gives again."""

    def __init__(self, config: Config = DEFAULT) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        pages = lambda name, entry: handle.getMapState(name, "page long", f"entries array<struct<{entry}>>")
        self.now = handle.getValueState("now", f"{_PLACE}, queued long, done long, undone long, token long, seq long")
        self.queue = pages("queue", "gap_start: long, gap_end: long, gap_type: string")
        self.done = Entries(pages("done", "place: long, type: string, first: long, last: long, seg_start: long, seg_end: long, answer: int"))
        self.undone = Entries(pages("undone", "answer: int"))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        """A page of the session's queue; pages come in any order."""
        now = self._load()
        gaps = list(zip(*(initialState[c] for c in ("gap_start", "gap_end", "gap_type")), strict=True))
        self.queue.updateValue((initialState["page"],), (gaps,))
        self.now.update(tuple({**now, "queued": now["queued"] + len(gaps)}.values()))

    def _load(self) -> dict:
        names = ("place", "type", "first", "last", "queued", "done", "undone", "token", "seq")
        return dict(zip(names, self.now.get() or (1, None, None, None, 0, 0, 0, 0, None), strict=True))

    def _gap(self, place: int) -> tuple[int, int, str]:
        page, at = divmod(place - 1, PAGE)
        if page not in self.gaps:
            self.gaps[page] = [tuple(g) for g in self.queue.getValue((page,))[0]]
        return self.gaps[page][at]

    def _step(self, now: dict, answer: int) -> None:
        """The live segment takes an answer."""
        end = self._gap(now["place"])[1]
        low, high, rest = answered(now["type"], now["first"], now["last"], end, answer, self.config)
        self.done.push(now["place"], now["type"], now["first"], now["last"], low, high, answer)
        if rest is None:
            now["place"] += 1
        now["type"], now["first"], now["last"] = rest or (None, None, None)

    def _open(self, now: dict) -> bool:
        """Whether a segment is live; the next gap's first one if the last gap is done."""
        if now["type"] is None and now["place"] <= now["queued"]:
            now["type"], now["first"], now["last"] = opened(*self._gap(now["place"]), self.config)
        return now["type"] is not None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, changed, self.gaps = self._load(), set(), {}
        done, undone = self.done, self.undone
        done.open(now["done"])
        undone.open(now["undone"])
        for e in sorted(rows, key=lambda r: r["seq"]):
            if now["seq"] is not None and e["seq"] <= now["seq"]:
                continue
            now["seq"] = e["seq"]
            live = self._open(now)
            if e["token"] is not None and e["token"] != now["token"]:
                continue
            if e["kind"] in ("ANSWER", "SKIP") and live:
                undone.clear()
                self._step(now, -1 if e["kind"] == "SKIP" else e["answer"])
                changed.add(done.n)
            elif e["kind"] == "UNDO" and done.n:
                changed.add(done.n)
                now["place"], now["type"], now["first"], now["last"], _, _, answer = done.pop()
                undone.push(answer)
            elif e["kind"] == "REDO" and undone.n and live:
                self._step(now, *undone.pop())
                changed.add(done.n)
            else:
                continue
            now["token"] += 1
        live = self._open(now)
        done.save()
        undone.save()
        self.now.update(tuple({**now, "done": done.n, "undone": undone.n}.values()))
        make = Row("session", "step", "gap_start", "gap_end", "gap_type", "seg_start", "seg_end", "value", "show_frame", "token")
        gap = self._gap(now["place"]) if live else (None, None, None)
        yield make(key[0], 0, *gap, now["first"], now["last"], None, shown(now["type"], now["first"], now["last"]) if live else None, now["token"])
        for step in sorted(changed):
            if step > done.n:
                yield make(key[0], step, None, None, None, None, None, None, None, now["token"])
                continue
            place, _, _, _, low, high, answer = done[step]
            yield make(key[0], step, *self._gap(place), low, high, answer, None, now["token"])

    def close(self) -> None:
        pass


def queue(g: DataFrame) -> DataFrame:
    """session, page (from 0) and arrays gap_start, gap_end, gap_type of the gaps under review: an animal's gaps in order, PAGE to a page."""
    open_ = g.filter("route in ('checkpoints', 'bisect')").select("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME", "gap_type")
    placed = row_numbers(open_, "GAP_START_FRAME", "place")
    gap = F.struct("place", F.col("GAP_START_FRAME").alias("gap_start"), F.col("GAP_END_FRAME").alias("gap_end"), "gap_type")
    paged = placed.groupBy(F.col("ANIMALID").alias("session"), F.expr(f"(place - 1) div {PAGE}").cast("long").alias("page")).agg(F.sort_array(F.collect_list(gap)).alias("_gaps"))
    return paged.select("session", "page", *[F.col(f"_gaps.{c}").alias(c) for c in ("gap_start", "gap_end", "gap_type")])


def live(events: DataFrame, g: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Changes (CHANGES) of the reviews of all animals of a table of gaps, from a stream or a table of events.

    A sink that keeps the row with the greatest token of each (session, step)
    holds what is shown and what is decided; `standing` does so for a table of changes.
    """
    use_state_store(events.sparkSession)
    return events.groupBy("session").transformWithState(Live(c), CHANGES, "update", "none", queue(g).groupBy("session"))


def standing(changes: DataFrame) -> DataFrame:
    """The last row of each session and step."""
    rest = [c for c in changes.columns if c not in ("session", "step")]
    return changes.groupBy("session", "step").agg(F.max_by(F.struct(*rest), "token").alias("v")).select("session", "step", *[f"v.{c}" for c in rest])


def decided(changes: DataFrame) -> DataFrame:
    """The decided ranges, as review.segments gives them."""
    s = standing(changes).filter("step > 0 and seg_start is not null")
    names: dict[str, Column] = {"ANIMALID": F.col("session"), "GAP_START_FRAME": F.col("gap_start"), "GAP_END_FRAME": F.col("gap_end"), "gap_type": F.col("gap_type"), "seg_start": F.col("seg_start"), "seg_end": F.col("seg_end"), "value": F.col("value").cast("long")}
    return s.select(*[v.alias(k) for k, v in names.items()])


def scripted(reviewed: DataFrame) -> DataFrame:
    """A log (EVENTS) whose outcome is a finished review (review.resolve), with what happens on the way.

    Before some answers the reviewer gives the opposite one, takes it back, in
    part after giving it again; some events carry a token that is never current,
    and some come twice.
    """
    steps = reviewed.select("ANIMALID", "GAP_START_FRAME", F.posexplode("state.segs").alias("k", "seg"))
    seq, a = F.col("GAP_START_FRAME") * 1_000_000 + F.col("k") * 8, F.col("seg.value").cast("int")
    event = lambda at, kind, answer, token=None: F.struct((seq + at).alias("seq"), F.lit(kind).alias("kind"), answer.cast("int").alias("answer"), F.lit(token).cast("long").alias("token"))
    none, other, right = F.lit(None), F.when(a == 1, 0).otherwise(1), event(7, "ANSWER", a)
    h = F.pmod(F.col("seg.seg_start") + F.col("ANIMALID"), F.lit(7))
    back = F.array(event(1, "ANSWER", other), event(2, "UNDO", none), right)
    twice = F.array(event(1, "ANSWER", other), event(2, "UNDO", none), event(3, "REDO", none), event(4, "UNDO", none), right)
    stale = F.array(event(1, "ANSWER", other, -1), event(2, "SKIP", none, -1), right, right)
    return steps.select(F.col("ANIMALID").alias("session"), F.inline(F.when(h == 0, back).when(h == 1, twice).when(h == 2, stale).otherwise(F.array(right))))
