"""How often a batch of events calls the state of its session: by pages, not by gaps, steps or events."""

import random

import pytest
from pyspark.sql import Row

from frameloom.streaming import live_review as live


class State(dict):
    """A map or value state that counts its calls."""

    def __init__(self, calls):
        self.calls = calls

    def getValue(self, key):
        self.calls.append("get")
        return dict.get(self, key)

    def updateValue(self, key, value):
        self.calls.append("put")
        self[key] = value

    def removeKey(self, key):
        self.calls.append("remove")
        del self[key]

    def get(self):
        return self.getValue(())

    def exists(self):
        return () in self

    def update(self, value):
        self.updateValue((), value)


class Handle:
    def __init__(self):
        self.calls, self.states = [], {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State(self.calls))

    def getMapState(self, name, key, value):
        return self.getValueState(name, value)


def reviewed(n):
    """A processor whose session has n gaps of one answer each, and its handle."""
    handle, processor = Handle(), live.Live()
    processor.init(handle)
    gaps = [(1000 * k, 1000 * k + 950, "10") for k in range(n)]
    for page in range(-(-n // live.PAGE)):
        start, end, kind = zip(*gaps[page * live.PAGE : (page + 1) * live.PAGE])
        processor.handleInitialState((1,), Row(page=page, gap_start=start, gap_end=end, gap_type=kind), None)
    handle.calls.clear()
    return processor, handle


def events(kinds, seq=0):
    return iter([Row(session=1, seq=seq + k, kind=kind, answer=answer, token=None) for k, (kind, answer) in enumerate(kinds)])


def test_a_batch_calls_the_state_by_pages():
    processor, handle = reviewed(150)
    log = [e for _ in range(150) for e in (("ANSWER", 0), ("UNDO", None), ("REDO", None), ("UNDO", None), ("ANSWER", 1))]
    out = list(processor.handleInputRows((1,), events(log), None))
    assert len(out) == 151 and all(r["value"] == 1 for r in out[1:])
    assert len(handle.calls) <= 2 + 2 * 3  # where it stands, and three pages of gaps and of steps


@pytest.mark.parametrize("seed", range(6))
def test_pages_across_batches(seed):
    rng = random.Random(seed)
    log = [rng.choice((("ANSWER", 0), ("ANSWER", 1), ("ANSWER", 1), ("UNDO", None), ("UNDO", None), ("REDO", None)) if k % 300 < 150 else (("ANSWER", 1), ("UNDO", None), ("UNDO", None), ("REDO", None))) for k in range(900)]
    log = [("ANSWER", 0)] * 130 + log
    processor, handle = reviewed(400)
    stands = {}
    seq = 0
    while seq < len(log):
        size = rng.randint(1, 90)
        for r in processor.handleInputRows((1,), events(log[seq : seq + size], seq), None):
            stands[r["step"]] = (r["gap_start"], r["seg_start"], r["seg_end"], r["value"])
        seq += size
    done, undone, want = [], [], {}
    for kind, answer in log:
        if kind == "ANSWER":
            done, undone = [*done, answer], []
        elif kind == "UNDO" and done:
            undone.append(done.pop())
        elif kind == "REDO" and undone:
            done.append(undone.pop())
    want = {k + 1: (1000 * k, 1000 * k + 1, 1000 * k + 949, a) for k, a in enumerate(done)}
    assert {k: v for k, v in stands.items() if k and v[1] is not None} == want
    for name, n in (("done", len(done)), ("undone", len(undone))):
        assert sum(len(v[0]) for v in handle.states[name].values()) == n
