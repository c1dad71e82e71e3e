"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The program
asks for the fewest uses, in fractions, of configurations that cover every
length's count. Multiplicative weights solve it: a length's price falls
exponentially with the share of its count that is covered, a dynamic program
over capacities (an unbounded knapsack) finds the configuration worth most at
the present prices, and a small part of what would cover one of its lengths is used of it. As
prices only fall, the last knapsack's worth stays an upper bound: a
configuration drawn from its table at the present prices serves as long as it
is nearly worth that, and a new knapsack is solved only when it is not. Prices
divided by the worth of the best configuration are a feasible dual, so
every knapsack also gives a lower bound on the number of sequences.

Uses are rounded down; what is left is packed best-fit by decreasing length,
into the free places of all sequences. This is done again with finer steps until the result is
within GAP of the bound. The program sees only the
histogram, which has as many entries as a sequence has places, whatever the
corpus holds.
"""

from __future__ import annotations

import math
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, passes, prepare, tidied
from .substring_dedup import runs
from .token_counts import BARE, LONGEST, PLAIN, Pieces

#: A plan this close to the lower bound is good enough; else the next finer step is tried, as long as EFFORT steps in all allow.
GAP, STEPS, EFFORT = 0.0005, (1.0, 0.5, 0.25, 0.1, 0.05, 0.02, 0.01), 60_000
#: Bytes of text whose words are told apart at once (or one longer text), words that a worker remembers of late, and as many of before.
WORDS_BYTES, REMEMBERED = 4 << 20, 200_000
#: A Latin-1 letter and a mark that ends a word.
MARKED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])([\t-\r ]|$)"
_loaded: dict[str, Words] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Words:
    """Ids of whole texts from the ids of their words, of which each distinct one of a pass is looked up once.

    Words end at ASCII white space and before a mark that ends them, where
    pre-tokens end, too; strings of special tokens hold neither. A word is one pre-token, or several.
    """

    def __init__(self, path: str) -> None:
        self.pieces, self.known, self.older = Pieces.of(path, BARE, _bytes), {}, {}

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words."""
        if len(self.known) > REMEMBERED:  # those not seen since the last time go
            self.known, self.older = {}, self.known
        out = [self.known.get(w) or self.older.get(w) for w in words]
        new = [k for k, x in enumerate(out) if x is None]
        split = [[words[k]] if PLAIN.fullmatch(words[k]) else self.pieces.split(words[k]) for k in new]
        single = list(set().union(*split))
        of = dict(zip(single, self.pieces.encode(single), strict=True))
        for k, tokens in zip(new, split, strict=True):
            out[k] = b"".join([of[t] for t in tokens])
        self.known.update((w, x) for w, x in zip(words, out, strict=True) if len(w) <= LONGEST)
        return out

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text and end_id, one text after the other, and where each begins."""
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), MARKED, r"\1 \2\3"))
        n = len(split)
        words = split.flatten().dictionary_encode()
        ends = np.cumsum(split.value_lengths().to_numpy())
        which = words.indices.to_numpy().astype(np.int64)
        of = self.encode(words.dictionary.to_pylist())
        found, size = np.frombuffer(b"".join(of), "<u4"), np.array([len(x) // 4 for x in of], np.int64)
        # Every text's last word is end_id.
        found, size = np.append(found, np.uint32(end_id)), np.append(size, 1)
        which = np.insert(which, ends, len(size) - 1)
        first, length = np.cumsum(size) - size, size[which]
        past = np.cumsum(length)
        place = np.repeat(first[which] - past + length, length) + np.arange(int(past[-1]) if n else 0)
        return found[place], np.concatenate([[0], past[ends + np.arange(n)]])


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most `capacity` tokens of each document's ids and end_id.

    part and nth number a piece among those of its length in its task.
    """
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seen = Words.of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            offsets = binary(batch.column(1))[1]
            for lo, hi in passes(offsets, WORDS_BYTES):
                ids, at = known.ids(batch.column(1).slice(lo, hi - lo), end_id)
                size = np.diff(at)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(hi - lo), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * capacity
                length = np.minimum(size[doc] - start, capacity)
                begin, data = (4 * (at[doc] + start)).tolist(), memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(data[b : b + 4 * n]) for b, n in zip(begin, length.tolist(), strict=True)]
                # A piece's number among those of its length: the task's number so far, and its place in this pass.
                by = np.argsort(length, kind="stable")
                first, n = runs(length[by])
                rank = np.empty(len(length), np.int64)
                rank[by] = seen[length[by]] + np.arange(len(by)) - np.repeat(first, n)
                seen[length[by][first]] += n
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(nth.astype(np.int32)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(work), PIECES)


class Knapsack:
    """Configurations by unbounded dynamic programming over capacities."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.at = np.full(capacity + 1, -1)
        self.at[lengths] = np.arange(len(lengths))
        self.place = np.full(capacity + 1, -math.inf)
        self.worth = np.zeros(capacity + 1)

    def price(self, which: np.ndarray, prices: np.ndarray) -> None:
        """Sets prices; a length without a price is not held."""
        self.place[self.lengths[which]] = np.where(prices > 0, prices, -math.inf)

    def solve(self) -> float:
        """What the best configuration is worth."""
        worth, place, top = np.zeros(self.capacity + 1), self.place, self.capacity
        priced = self.lengths[place[self.lengths] > 0]
        # One pass per length over blocks of it, or one pass over all lengths per capacity.
        if int((top // priced).sum()) < top:
            for n in priced.tolist():
                for lo in range(n, top + 1, n):
                    part = worth[lo : lo + n]
                    np.maximum(part, worth[lo - n : lo - n + len(part)] + place[n], out=part)
        else:
            for c in range(1, top + 1):
                worth[c] = max(worth[c - 1], (place[1 : c + 1] + worth[c - 1 :: -1] if c > 1 else place[1:2]).max())
        self.worth = worth
        return float(worth[top])

    def draw(self) -> tuple[tuple[int, int], ...]:
        """A configuration (number of the length, copies) that follows the table at the present prices."""
        held, c = Counter(), self.capacity
        while c > 0:
            options = self.place[1 : c + 1] + self.worth[c - 1 :: -1] if c > 1 else self.place[1:2]
            n = int(options.argmax()) + 1
            if self.place[n] <= 0:
                break
            held[int(self.at[n])] += 1
            c -= n
        return tuple(sorted(held.items()))


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float, effort: int) -> tuple[dict[tuple, float], float, int]:
    """How often each configuration is used so that all counts are covered, a lower bound on any such cover, and the steps taken.

    If `effort` steps do not cover all, what they cover is returned.
    """
    rate = math.log(len(lengths) + 1) / step
    part = min(1.0, step / rate)
    share, used = np.zeros(len(lengths)), Counter()
    prices = lengths.astype(np.float64)  # the best dual where all sequences can be filled
    knapsack = Knapsack(lengths, capacity)
    knapsack.price(np.arange(len(lengths)), prices)
    worth = knapsack.solve()
    bound, steps, open_ = float(counts @ prices) / worth, 0, len(lengths)
    while open_ and steps < effort:
        config = knapsack.draw()
        which, copies = np.array([k for k, _ in config]), np.array([n for _, n in config])
        if float(prices[which] @ copies) < (1 - min(0.1, step / 2)) * worth:
            worth = knapsack.solve()
            bound = max(bound, float(counts @ prices) / worth)
            config = knapsack.draw()
            which, copies = np.array([k for k, _ in config]), np.array([n for _, n in config])
        times = part * float((counts[which] / copies).min())
        before = share[which]
        share[which] = before + copies * times / counts[which]
        now = share[which] >= 1 - 1e-9
        open_ -= int((now & (before < 1 - 1e-9)).sum())
        prices[which] = np.where(now, 0.0, lengths[which] * np.exp(-rate * share[which]))
        knapsack.price(which, prices[which])
        used[config] += times
        steps += 1
    return used, bound, steps


class Sequences:
    """Pieces by length and rank, put into sequences; rows are (length, first rank, past the last rank, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.left, self.capacity = dict(histogram), capacity
        self.rank = dict.fromkeys(histogram, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.used = 0
        #: Free places, rising, and the ranges of sequences (first, how many) that have so many.
        self.room: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, copies: int, first: int, times: int, offset: int) -> None:
        for _ in range(copies):
            self.rows.append((length, self.rank[length], self.rank[length] + times, first, offset))
            self.rank[length] += times
            self.left[length] -= times
            offset += length
        self.free(self.capacity - offset, first, times)

    def free(self, places: int, first: int, times: int) -> None:
        if places and times:
            if places not in self.open:
                insort(self.room, places)
                self.open[places] = []
            self.open[places].append((first, times))

    def use(self, config: list[tuple[int, int]], times: int) -> None:
        """New sequences that each hold this configuration."""
        first, offset = self.used, 0
        for length, copies in config:
            for _ in range(copies):
                self.rows.append((length, self.rank[length], self.rank[length] + times, first, offset))
                self.rank[length] += times
                offset += length
            self.left[length] -= copies * times
        self.used += times
        self.free(self.capacity - offset, first, times)

    def best_fit(self) -> None:
        """What is left, the longest first, each into the sequence with the least sufficient room; whole ranges of sequences at a time."""
        for length in sorted((k for k, n in self.left.items() if n > 0), reverse=True):
            while left := self.left[length]:
                at = bisect_left(self.room, length)
                if at < len(self.room):
                    places = self.room[at]
                    first, times = self.open[places].pop()
                    if not self.open[places]:
                        del self.open[places], self.room[at]
                else:
                    places, first, times = self.capacity, self.used, left
                copies = min(left, places // length)
                take = min(times, left // copies)
                if places == self.capacity and first == self.used:
                    self.used += take
                else:
                    self.free(places, first + take, times - take)
                self.put(length, copies, first, take, self.capacity - places)


def plan(histogram: dict[int, int], capacity: int, gap: float = GAP, effort: int = EFFORT) -> tuple[np.ndarray, int, int]:
    """Rows (length, first rank, past the last rank, first sequence, offset), the number of sequences, and a number that no plan can undercut.

    The piece of this length and rank goes to the first sequence plus its
    distance from the first rank, at this offset.
    """
    histogram = {int(k): int(n) for k, n in histogram.items() if n > 0}
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(k for k in histogram if k < capacity), np.int64)
    counts = np.array([histogram[k] for k in lengths.tolist()], np.float64)
    best = None
    for step in STEPS:
        used, bound, steps = cover(lengths, counts, capacity, step, effort) if len(lengths) else ({}, 0.0, 0)
        effort -= steps
        least = max(least, full + math.ceil(bound - 1e-6))
        held = {config: [(int(lengths[k]), n) for k, n in config] for config in used}
        waste = {config: capacity - sum(n * k for n, k in held[config]) for config in used}
        usual = sum(used[c] * waste[c] for c in used) / sum(used.values()) if used else 0.0
        # Those that fill a sequence best come first, as all of them together cover a little too much.
        order = sorted(used, key=lambda c: (waste[c], -used[c], c))
        # All rounded down; or, which is better where no short pieces are left to fill places, those up that waste less than is usual.
        for up in (False, True):
            now = Sequences(histogram, capacity)
            if full:
                now.use([(capacity, 1)], full)
            for config in order:
                times = min(math.ceil(used[config] - 1e-6) if up and waste[config] < usual else int(used[config] + 1e-6), *(now.left[n] // k for n, k in held[config]))
                if times:
                    now.use(held[config], times)
            now.best_fit()
            if best is None or now.used < best.used:
                best = now
        if best.used <= least * (1 + gap) or best.used == least or effort <= 0:
            break
    return np.array(sorted(best.rows), np.int64).reshape(-1, 5), best.used, least


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, gap: float = GAP, effort: int = EFFORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece, and least_sequences, which no packing can undercut.

    A null or empty text is one piece of end_id; ids are whole numbers, and a null one stays
    null; repeated rows are packed each; an empty table gives an empty table. A worker holds the ids of one text at a time. Pieces are checkpointed once, as ids are
    costly. The driver sees the histogram, at most `capacity` counts; a piece's
    rank among those of its length is its task's first rank plus its number
    there, so no length's pieces meet in one task. Which sequence holds which
    piece of a length may change between runs, their number does not.
    """
    made = pieces(docs, path, capacity, end_id, id_col, text_col).checkpoint()
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _, least = plan(histogram, capacity, gap, effort)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(rows[:, 2].max()) + 1
        key = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * width + rank, "right") - 1
            own = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(firsts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("least_sequences", F.lit(least).cast("long"))
