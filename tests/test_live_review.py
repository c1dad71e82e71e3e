"""The live review: scripts of one session, and streams cut anywhere against the batch fold."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import simulate

from frameloom.config import Config
from frameloom.operators import gaps, review
from frameloom.streaming import live_review as live

GAPS = "ANIMALID long, GAP_START_FRAME long, GAP_END_FRAME long, gap_type string, size long, fill int, route string"


def table(spark, rows):
    """Gaps (animal, start, end, type) that are all reviewed."""
    return spark.createDataFrame([(a, s, e, t, e - s - 1, -1, "checkpoints" if t == "00" else "bisect") for a, s, e, t in rows], GAPS)


def session(spark, gaps_, events):
    """What is shown, and the standing ranges, after events (kind, answer[, token]) of one session."""
    log = [(1, k, e[0], e[1] if len(e) > 1 else None, e[2] if len(e) > 2 else None) for k, e in enumerate(events)]
    changes = live.standing(live.live(spark.createDataFrame(log, live.EVENTS), table(spark, [(1, *g) for g in gaps_]))).orderBy("step").collect()
    shown = changes[0]
    return (shown["gap_type"], shown["seg_start"], shown["seg_end"], shown["show_frame"], shown["token"]), [(r["seg_start"], r["seg_end"], r["value"]) for r in changes[1:] if r["seg_start"] is not None]


OUT, IN, SKIP, UNDO, REDO = ("ANSWER", 0), ("ANSWER", 1), ("SKIP",), ("UNDO",), ("REDO",)
GAP = (1000, 6552, "00")


@pytest.mark.parametrize(
    ("gaps_", "events", "shown", "ranges"),
    [
        ([GAP], [("SHOW",)], ("00", 1001, 2800, 2800, 0), []),
        # Undo and redo across checkpoints.
        ([GAP], [OUT, UNDO], ("00", 1001, 2800, 2800, 2), []),
        ([GAP], [OUT, UNDO, REDO], ("00", 2801, 4600, 4600, 3), [(1001, 2800, 0)]),
        # The first checkpoint in the nest hands the rest over; undo takes that back, redo does it again.
        ([GAP], [IN], ("00", 2801, 6551, 4676, 1), [(1001, 2800, 1)]),
        ([GAP], [IN, UNDO], ("00", 1001, 2800, 2800, 2), []),
        ([GAP], [IN, UNDO, REDO], ("00", 2801, 6551, 4676, 3), [(1001, 2800, 1)]),
        ([GAP], [OUT, OUT, IN], ("00", 6401, 6551, 6476, 3), [(1001, 2800, 0), (2801, 4600, 0), (4601, 6400, 1)]),
        ([GAP], [OUT, OUT, OUT, IN], (None, None, None, None, 4), [(1001, 2800, 0), (2801, 4600, 0), (4601, 6400, 0), (6401, 6551, 1)]),
        # A skip of what was handed over; a skip of a checkpoint leaves the next ones.
        ([GAP], [IN, SKIP], (None, None, None, None, 2), [(1001, 2800, 1), (2801, 6551, -1)]),
        ([GAP], [OUT, SKIP], ("00", 4601, 6400, 6400, 2), [(1001, 2800, 0), (2801, 4600, -1)]),
        # The gap's next segment goes before the next gap; after it, that gap is shown.
        ([GAP, (9000, 9101, "10")], [IN], ("00", 2801, 6551, 4676, 1), [(1001, 2800, 1)]),
        ([GAP, (9000, 9101, "10")], [IN, SKIP], ("10", 9001, 9100, 9050, 2), [(1001, 2800, 1), (2801, 6551, -1)]),
        # What undo took back cannot be given again after another answer; nothing to undo or redo has no effect.
        ([GAP], [UNDO, REDO, OUT, UNDO, IN, REDO], ("00", 2801, 6551, 4676, 3), [(1001, 2800, 1)]),
        # An event for a frame that is no longer shown is dropped.
        ([GAP], [("ANSWER", 0, 0), ("ANSWER", 1, 0), ("ANSWER", 0, 1)], ("00", 4601, 6400, 6400, 2), [(1001, 2800, 0), (2801, 4600, 0)]),
    ],
)
def test_sessions(spark, gaps_, events, shown, ranges):
    got, standing = session(spark, gaps_, events)
    assert (got, standing) == (shown, ranges)


def test_an_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="unknown gap type"):
        session(spark, [(1000, 6552, "99")], [IN])


def sessions(seed, animals=4):
    """Gaps of some animals, the answer to every frame, and a log in which answers are mixed with undo, redo, stale and repeated events."""
    rng = random.Random(seed)
    found, log = [], []
    said = lambda a, f: (-1 if (f * 11 + a) % 13 == 0 else int((f * 7 + a * 13) % 100 < 45))
    for a in range(animals):
        at, seq = 0, 0
        for _ in range(rng.randint(1, 4)):
            at += rng.randint(2, 50)
            end = at + rng.choice((2, 900, 2500, 9000, 20_000))
            found.append((a, at, end, rng.choice(("00", "01", "10"))))
            at = end
        steps = []
        for _, s, e, t in [g for g in found if g[0] == a]:
            kind, first, last = live.opened(s, e, t, Config())
            while True:
                v = said(a, live.shown(kind, first, last))
                steps.append(v)
                _, _, rest = live.answered(kind, first, last, e, v, Config())
                if rest is None:
                    break
                kind, first, last = rest
        for v in steps:
            for e in rng.choice(([], [], [("ANSWER", 1 - abs(v), None), ("UNDO", None, None)], [("SKIP", None, None), ("UNDO", None, None), ("REDO", None, None), ("UNDO", None, None)], [("ANSWER", v, -5)])):
                seq += rng.randint(1, 3)
                log.append((a, seq, *e))
            seq += 1
            log.append((a, seq, "ANSWER", v, None))
            if rng.random() < 0.2:
                log.append(log[-1])
    return found, log, said


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_cut_anywhere_equal_the_batch_fold(spark, tmp_path, seed):
    found, log, said = sessions(seed)
    g = table(spark, found)
    want = {}
    for a, s, e, t in found:
        want |= {(a, f): v for f, v in simulate((s, e, t), lambda f, a=a: said(a, f)).items()}
    frames = lambda df: {(r["ANIMALID"], f): r["value"] for r in df.collect() for f in range(r["seg_start"], r["seg_end"] + 1)}
    assert frames(live.decided(live.live(spark.createDataFrame(log, live.EVENTS), g))) == want
    answer = lambda m: F.when((m * 11 + F.col("ANIMALID")) % 13 == 0, -1).when((m * 7 + F.col("ANIMALID") * 13) % 100 < 45, 1).otherwise(0)
    assert frames(review.segments(g, answer)) == want
    # The same log as a stream: batches that are cut at random, each animal's events in order across them.
    rng, source = random.Random(seed), str(tmp_path / "log")
    cuts = sorted(rng.sample(range(len(log)), 3))
    order = sorted(log, key=lambda r: (r[1], r[0]))
    for low, high in zip([0, *cuts], [*cuts, len(order)]):
        spark.createDataFrame(order[low:high], live.EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = live.live(spark.readStream.schema(live.EVENTS).option("maxFilesPerTrigger", 1).parquet(source), g)
    out = str(tmp_path / "out")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    changes = spark.read.parquet(out)
    assert frames(live.decided(changes)) == want
    assert live.standing(changes).filter("step = 0 and show_frame is not null").count() == 0


def test_a_scripted_log_gives_the_review_back(spark):
    rows = [(a, f, x, 50.0) for a in (1, 2) for f, x in ((0, 30.0), (4000, 70.0), (9000, 200.0), (16_000, 200.0), (16_001, 30.0), (19_000, 30.0))]
    g = gaps.gaps(gaps.classify(spark.createDataFrame(rows, "ANIMALID long, FRAMENUMBER long, MASS_X double, MASS_Y double")))
    answer = lambda m: (m % 3 - 1).cast("int")
    got = live.decided(live.live(live.scripted(review.resolve(g, answer)), g)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, review.segments(g, answer).collect())) and got
