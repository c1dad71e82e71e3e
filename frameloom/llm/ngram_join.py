"""Jaccard self-join of documents' word n-grams by T-occurrence search (DivideSkip).

Two sets of sizes x and y with similarity t share at least T = t / (1 + t) *
(x + y) members. In any fixed order of all n-grams such sets then share SHARED
(or T, if that is less) of the first x - t * x + SHARED of x, its prefix. The
order puts n-grams that many documents hold last: those found often in some
chunk are counted over all chunks, and at most HEAVY of them, the most
frequent, are ordered by their count; all others by their hash. (The order
decides only how much work there is.)

Two parts of a prefix matter more: sets that are alike share a member among the
first x - t * x + 1 of the larger one (where it asks) and the first
x - 2 t / (1 + t) * x + 1 of the smaller one (where it is held). A prefix
member that at most FEW sets have counts for each pair of them; a pair is a
candidate if it reaches SHARED less the members of its prefix that more have.
Sets that share a member which more have are candidates only if one holds it
and the other asks for it: these meet in a block named by the least of them, one
for each class of sizes, and a member that only asks have needs no block at
all. Members found HOT times or oftener name blocks themselves, so that their lists meet in no task. Candidate pairs of rare
members meet in blocks named by the least neighbour of either.

A block numbers the n-grams of its documents exactly, by their words, and
answers, for each that asks, a T-occurrence query over those that hold: the inverted lists of its members are divided into
the long ones and the rest, the short ones are merged by a heap and each
candidate with enough of them is completed by binary search in the long ones.
So every link is told by the words themselves, whatever links are known already. A pair that
meets in several blocks counts in the first of them, which the blocks of both
tell; a block returns how many documents each of its sets is linked to and the
links that join its components, never all pairs. Equal sets (by 122 bits) are collapsed before: the first row of
each set in a chunk stands for the chunk's others, and the first of these for all, so that copies meet nowhere.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary, mixed, parts_for, passes, pinned, prepare, release, rolling, rows_of, short_hashes, tidied, tidied_groups, word_hashes
from .components import components, looked_up, parted
from .substring_dedup import chunks, numbered, packed, runs
from .suffix_dedup import pack, unpack

#: N-grams ordered by frequency, at most; documents of a part of a block, and their n-grams (unless one has more), at most about.
HEAVY, BLOCK_ROWS, BLOCK_GRAMS = 1 << 20, 512, 1 << 19
#: Prefix members that a pair must share, and the most holders of one that are paired.
SHARED, FEW = 8, 12
#: Documents that hold an n-gram which names blocks itself.
HOT = 20_000
#: DivideSkip's weight of a candidate's probes against merging.
MU = 0.0085
#: Postings that a heap merges; beyond them, an array of counters does.
MERGED = 4096
#: Candidates of a query that binary search completes; beyond them, counters do.
COMPLETED = 32


def distinct(value: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each owner's distinct values are, owners and values rising, and each owner's first."""
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])]) if len(v) else np.zeros(0, bool)
    return order[new], np.concatenate([[0], np.cumsum(np.bincount(o[new], minlength=docs))]).astype(np.int64)


def sets(column: pa.Array, n: int, folded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each document, rising, each document's first, and other hashes of the same n-grams; texts with fewer than n words are one n-gram."""
    data, offsets = binary(column)
    out, second, sizes = [], [], []
    for lo, hi in passes(offsets):
        found = []
        for key in (0, 1):
            h, at = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], folded, key)
            count = np.diff(at)
            grams = rolling(h, n, key)
            doc = np.repeat(np.arange(hi - lo), count)
            whole = np.arange(len(grams)) + n <= at[1:][doc[: len(grams)]]
            short = np.flatnonzero((count > 0) & (count < n))
            found.append(np.concatenate([grams[whole], short_hashes(h, at[short], at[short + 1], key)]))
        pick, first = distinct(found[0], np.concatenate([doc[: len(grams)][whole], short]), hi - lo)
        out.append(found[0][pick])
        second.append(found[1][pick])
        sizes.append(np.diff(first))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64), np.concatenate([none, *second])


_FOLD = LOWER.tobytes()


def exact_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """As sets(), but each n-gram has a number of its own among these texts, without hashes."""
    number: dict[bytes, int] = {}
    # One text's words at a time; only distinct words and numbers are held.
    words = [np.array([number.setdefault(x, len(number)) for x in (t or "").encode().translate(_FOLD).split()], np.int64) for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    word = np.concatenate([np.zeros(0, np.int64), *words])
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    together = lambda a, b: np.unique(a * np.int64(int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)
    gram = np.zeros(0, np.int64)
    if len(word) >= n:
        m, h, step, done = len(word) - n + 1, word, 1, 0
        while True:  # by doubling, as Rabin-Karp hashes are made
            if n & step:
                gram, done = (h[:m] if not done else together(gram, h[done : done + m])), done + step
            if done == n:
                break
            h, step = together(h[:-step], h[step:]), 2 * step
    whole = np.arange(len(gram)) + n <= at[1:][doc[: len(gram)]]
    short = np.flatnonzero((count > 0) & (count < n))
    known: dict[tuple, int] = {}
    single = np.array([known.setdefault(tuple(words[k].tolist()), len(known)) for k in short.tolist()], np.int64) + int(gram.max(initial=0)) + 1
    value = np.concatenate([gram[whole], single])
    pick, first = distinct(value, np.concatenate([doc[: len(gram)][whole], short]), len(texts))
    return value[pick], first


class Similarity:
    """At least percent / 100, in whole numbers."""

    def __init__(self, percent: int) -> None:
        self.share = Fraction(percent, 100)

    def least_size(self, n: int) -> int:
        return math.ceil(self.share * n)

    def overlap(self, x, y):
        """100 * common >= percent * union, union = x + y - common."""
        p, q = self.share.numerator, self.share.denominator
        return -(-p * (x + y) // (p + q))

    def size_class(self, size: np.ndarray) -> np.ndarray:
        """Sets that are alike are of one class or of neighbouring ones."""
        width = max(1e-3, (math.log(self.share.denominator) - math.log(self.share.numerator)) * (1 + 1e-6))
        return np.floor(np.log(np.maximum(size, 1)) / width).astype(np.int64)


def t_occurrence(values: np.ndarray, at: np.ndarray, similarity: Similarity, parent: list[int]) -> list[tuple[int, int]]:
    """Every link between the sets values[at[k]:at[k + 1]], by DivideSkip; `parent` is updated.

    Sets come by rising size, so a query asks only the sets before it.
    """
    links = [(j, k) for k, found in t_queries(values, at, similarity) for j in found.tolist()]
    join(parent, links)
    return links


def join(parent: list[int], links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join components; `parent` is updated."""
    out = []
    for link in links:
        a, b = link
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(link)
    return out


def t_queries(values: np.ndarray, at: np.ndarray, similarity: Similarity, holds: np.ndarray | None = None, asks: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set that asks (all, if None), the sets before it that hold (all, if None) and that it is linked to."""
    size = np.diff(at)
    members, token = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(token, kind="stable")  # owners rise within a token
    if holds is not None:
        order = order[holds[owner[order]]]
    posting, begin = owner[order], np.searchsorted(token[order], np.arange(len(members) + 1))
    lists = token.astype(np.int64)
    for k in range(1, len(size)) if asks is None else np.flatnonzero(asks).tolist():
        n = int(size[k])
        if not n:
            continue
        least = int(np.searchsorted(size[:k], similarity.least_size(n)))
        if least >= k:
            continue
        mine = lists[at[k] : at[k + 1]]
        length = begin[mine + 1] - begin[mine]
        by = np.argsort(length, kind="stable")
        mine, length = mine[by], length[by]
        fewest = similarity.overlap(n, int(size[least]))
        long = min(fewest - 1, int(fewest / (MU * math.log2(max(2, int(length[-1]))) + 1)))
        short = len(mine) - long
        alone = 1 if holds is None or holds[k] else 0  # its own place in each list
        rest = [posting[begin[t] : begin[t + 1]] for t in mine[:short][length[:short] > alone].tolist()]
        rest = [p[np.searchsorted(p, least) : np.searchsorted(p, k)] for p in rest]
        rest = [p for p in rest if len(p)]
        if not rest:
            continue
        if sum(map(len, rest)) <= MERGED:
            counted = [(j, sum(1 for _ in g)) for j, g in groupby(heapq.merge(*(p.tolist() for p in rest)))]
            j, got = np.array(counted, np.int64).T
        else:  # so many postings that counters for all sets are cheaper than a heap
            got = np.bincount(np.concatenate(rest), minlength=k)
            j = np.flatnonzero(got)
            got = got[j]
        need = similarity.overlap(n, size[j])
        likely = got >= need - long
        j, got, need = j[likely], got[likely], need[likely]
        if not len(j):
            continue
        ranges = [(int(begin[t]), int(begin[t + 1])) for t in mine[short:][::-1].tolist()]
        if long and len(j) > COMPLETED:  # so many candidates that counters are cheaper for the long lists, too
            more = np.bincount(np.concatenate([posting[lo:hi] for lo, hi in ranges]), minlength=len(size))
            yield k, j[got + more[j] >= need]
            continue
        found = []
        for j, got, need in zip(j.tolist(), got.tolist(), need.tolist(), strict=True):
            left = long
            for lo, hi in ranges:
                if got >= need or got + left < need:
                    break
                p = bisect_left(posting, j, lo, hi)
                got += p < hi and posting[p] == j
                left -= 1
            if got >= need:
                found.append(j)
        if found:
            yield k, np.array(found, np.int64)


SENT = "bucket int, kind int, chunk long, n int, data binary"
ANSWER = "kind int, chunk long, n int, data binary"
LINKS = "a long, b long, n long"
#: Prefix members and the blocks they lead to; rows; pairs; how many members of a prefix many have; blocks that members name.
ENTRIES, ROWS, PAIRS, COMMON, NAMED = 0, 1, 2, 3, 4


def _heavy(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams that many documents hold, rising, and their counts; at most HEAVY."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            values, at, _ = sets(part["text"], n)
            values = np.sort(values)
            first, size = runs(values)
            often = size >= max(3, (len(at) - 1) // 2000)
            yield pa.RecordBatch.from_arrays([pa.array(values[first[often]].view(np.int64)), pa.array(size[often].astype(np.int64))], ["h", "n"])

    most = rows.select("rid", "text").mapInArrow(tidied(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY)
    found = most.toArrow()
    h, c = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _entries(n: int, similarity: Similarity, heavy: np.ndarray, counts: np.ndarray, buckets: int, hot: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in numbered(batches):
            values, at, second = sets(part["text"], n)
            size = np.diff(at)
            doc = np.repeat(np.arange(len(size)), size)
            # Which set a document has: sums of its members, by two hashes of them.
            total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(v ^ np.uint64(salt)))]) for v, salt in ((values, 0x5851F42D4C957F2D), (second, 0x14057B7EF767814F))]
            key = [(t[at[1:]] - t[at[:-1]]) for t in total]
            _, first, which = np.unique(np.stack([key[0], key[1], size.astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True)
            head = first[which.reshape(-1)]
            yield packed([(chunk % buckets, ROWS, chunk, len(size), pack(part["rid"].combine_chunks().to_numpy(), size, *key, head.astype("<i8")))], SENT)
            here = head == np.arange(len(size))
            weight = np.zeros(len(values), np.int64)
            if len(heavy):
                p = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
                weight = np.where(heavy[p] == values, counts[p], 0)
            order = np.lexsort((values, weight, doc))
            place = np.arange(len(values)) - at[doc]
            least = np.array([similarity.least_size(s) for s in range(int(size.max(initial=0)) + 1)], np.int64)
            asked, held = size - least[size] + 1, size - similarity.overlap(size, size) + 1
            keep = (place < (asked - 1 + SHARED)[doc]) & here[doc]
            role = (place < asked[doc]).astype("u1") + (place < held[doc])
            value, row, role, common = values[order][keep], doc[keep], role[keep], weight[order][keep] >= hot
            # Members that are found HOT times name blocks, one for each class of sizes; sets also ask in the class below theirs.
            told = np.bincount(row[common], minlength=len(size))
            if common.any():
                some = np.flatnonzero(told)
                yield packed([(chunk % buckets, COMMON, chunk, len(some), pack(some.astype("<i4"), told[some].astype("<i4")))], SENT)
            if len(k := np.flatnonzero(common & (role > 0))):
                own = similarity.size_class(size)[row[k]]
                name = [(mixed(value[k] + c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype("<i8") for c in (own, own - 1)]
                yield packed([(chunk % buckets, NAMED, chunk, 2 * len(k), pack(np.tile(row[k], 2).astype("<i4"), np.concatenate(name), np.concatenate([role[k] == 2, np.zeros(len(k), bool)]).astype("u1")))], SENT)
            value, row, role = value[~common], row[~common], role[~common]
            bucket = ((mixed(value) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                k = by[cut[b] : cut[b + 1]]
                if len(k):
                    yield packed([(b, ENTRIES, chunk, len(k), pack(value[k], row[k].astype("<i4"), size[row[k]].astype("<i4"), role[k]))], SENT)

    return work


def _leaders(similarity: Similarity):
    def work(group: pa.Table) -> pa.Table:
        """For each chunk: its pairs with earlier sets, its rows' members that many have, and the blocks its rows go to (named by their least set of the own class), with whether they hold there."""
        kind = group["kind"].to_numpy()
        passed = group.filter(pa.array(kind != ENTRIES)).select(["kind", "chunk", "n", "data"])
        group = group.filter(pa.array(kind == ENTRIES))
        if not len(group):
            return passed
        sizes = group["n"].to_numpy()
        value, row, size, role = (np.concatenate(x) for x in zip(*(unpack(d.as_py(), k, "<u8", "<i4", "<i4", "u1") for d, k in zip(group["data"], sizes.tolist(), strict=True)), strict=True))
        chunk = np.repeat(group["chunk"].to_numpy(), sizes)
        order = np.lexsort((row, chunk, size, value))
        v, s = value[order], size[order].astype(np.int64)
        # Sets whose sizes differ too much are never alike: a list falls apart where the next size is too large.
        least = np.array([similarity.least_size(int(x)) for x in range(int(s.max()) + 1)])
        run = np.cumsum(np.concatenate([[0], ((v[1:] != v[:-1]) | (least[s[1:]] > s[:-1])).astype(np.int64)]))
        first, k = runs(run)
        place = chunk << np.int64(20) | row  # a chunk has at most 2 ** 18 rows
        out = _pairs(similarity, order[np.repeat((k > 1) & (k <= FEW), k)], k[(k > 1) & (k <= FEW)], place, size)
        many = np.repeat(k > FEW, k)
        order, run = order[many], run[many]
        for lo, m, own in _by_chunk(chunk[order], row[order]):
            rows, times = np.unique(own, return_counts=True)
            out.append((COMMON, int(lo), len(rows), pack(rows.astype("<i4"), times.astype("<i4"))))
        # Blocks: a list's sets of one class of sizes and, asking only, those of the class above.
        order, run = order[role[order] > 0], run[role[order] > 0]
        cls = similarity.size_class(size[order])
        own = np.concatenate([order, order])
        home = np.repeat([True, False], len(order))
        block = np.stack([np.tile(run, 2), np.concatenate([cls, cls - 1])], 1)
        by = np.lexsort((place[own], ~home, block[:, 1], block[:, 0]))
        own, home, block = own[by], home[by], block[by]
        holds = home & (role[own] == 2)
        if len(own):
            first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]).any(1)]))
            length = np.diff(np.append(first, len(own)))
            leader = np.repeat(place[own[first]], length)  # home rows come first, the least before the others
            useful = np.repeat((np.add.reduceat(holds.astype(np.int64), first) > 0) & (length > 1), length)
            own, leader, holds = own[useful], leader[useful], holds[useful]
            told = np.unique(np.stack([chunk[own], row[own].astype(np.int64), leader, holds.astype(np.int64)], 1), axis=0)
            for lo, m in zip(*runs(told[:, 0]), strict=True):
                t = told[lo : lo + m]
                out.append((ENTRIES, int(t[0, 0]), int(m), pack(t[:, 1].astype("<i4"), t[:, 2].copy(), t[:, 3].astype("u1"))))
        return pa.concat_tables([passed, pa.Table.from_batches([packed(out, ANSWER)])])

    return work


def _by_chunk(chunk: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    by = np.argsort(chunk, kind="stable")
    for lo, m in zip(*runs(chunk[by]), strict=True):
        yield int(chunk[by[lo]]), int(m), row[by[lo : lo + m]]


def _pairs(similarity: Similarity, order: np.ndarray, length: np.ndarray, place: np.ndarray, size: np.ndarray) -> list[tuple]:
    """For the chunk of the later set of each pair: its row, the other set, how many members they share here and how many they must share."""
    found = []
    for n in np.unique(length):
        # All lists of one length at once, as a table.
        lists = order[np.repeat(length == n, length)].reshape(-1, n)
        a, b = np.triu_indices(n, 1)
        found.append(np.stack([lists[:, a].ravel(), lists[:, b].ravel()], 1))
    if not found:
        return []
    found = np.concatenate(found)
    swap = place[found[:, 0]] > place[found[:, 1]]
    found[swap] = found[swap][:, ::-1]
    x, y = place[found[:, 0]], place[found[:, 1]]
    by = np.lexsort((x, y))
    x, y, found = x[by], y[by], found[by]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    shared = np.diff(np.append(first, len(x)))
    x, y, found = x[first], y[first], found[first]
    need = np.minimum(SHARED, similarity.overlap(size[found[:, 0]].astype(np.int64), size[found[:, 1]].astype(np.int64)))
    out = []
    for lo, m in zip(*runs(y >> 20), strict=True):
        s = slice(lo, lo + m)
        out.append((PAIRS, int(y[lo] >> 20), int(m), pack((y[s] & ((1 << 20) - 1)).astype("<i4"), x[s].copy(), np.minimum(shared[s], 255).astype("u1"), need[s].astype("u1"))))
    return out


ROW = "rid long, size long, set binary, place long, head long, copies long, leaders array<long>, holds array<long>, near array<long>"


def _rows(group: pa.Table) -> pa.Table:
    """Each row of a chunk: rid, size, set, place, the chunk's first row with its set, and of that one the number of such rows, its blocks, those where it holds, and the earlier sets with which it shares enough."""
    kind, sizes, data = group["kind"].to_pylist(), group["n"].to_pylist(), group["data"]
    k = kind.index(ROWS)
    rid, size, a, b, head = unpack(data[k].as_py(), sizes[k], "<i8", "<i8", "<u8", "<u8", "<i8")
    of = lambda what, *kinds: [unpack(data[j].as_py(), sizes[j], *kinds) for j, x in enumerate(kind) if x in what]
    blocks: list[list[int]] = [[] for _ in range(len(rid))]
    holds: list[list[int]] = [[] for _ in range(len(rid))]
    near: list[list[int]] = [[] for _ in range(len(rid))]
    if found := of((ENTRIES, NAMED), "<i4", "<i8", "u1"):
        told = np.unique(np.stack([np.concatenate([np.asarray(f[c], np.int64) for f in found]) for c in range(3)], 1), axis=0)
        last = np.append((told[1:, :2] != told[:-1, :2]).any(1), True)  # of a row's places in a block, the one that holds
        for row, leader, held in told[last].tolist():
            blocks[row].append(leader)
            if held:
                holds[row].append(leader)
    common = np.zeros(len(rid), np.int64)
    for row, times in of((COMMON,), "<i4", "<i4"):
        np.add.at(common, row, times)
    if found := of((PAIRS,), "<i4", "<i8", "u1", "u1"):
        row, other, shared, need = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((other, row))
        row, other, shared, need = row[by], other[by], shared[by].astype(np.int64), need[by].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])]))
        # What the two share of members that many have is not counted: at most all of the row's own.
        enough = first[np.add.reduceat(shared, first) >= np.maximum(1, need[first] - common[row[first]])]
        for r, o in zip(row[enough].tolist(), other[enough].tolist(), strict=True):
            near[r].append(o)
    chunk = group["chunk"][k].as_py() << 20
    longs = pa.list_(pa.int64())
    sets_ = pa.array([x.tobytes() + y.tobytes() for x, y in zip(a, b, strict=True)], pa.binary())
    copies = np.bincount(head, minlength=len(rid))
    return pa.table([pa.array(rid), pa.array(size), sets_, pa.array(chunk + np.arange(len(rid))), pa.array(chunk + head), pa.array(copies.astype(np.int64)), pa.array(blocks, longs), pa.array(holds, longs), pa.array(near, longs)], [f.split()[0] for f in ROW.split(", ")])


def _blocks(placed: DataFrame) -> DataFrame:
    """place, the blocks (leader) to which its set goes, and whether it holds there."""
    pairs = placed.filter("size(near) > 0").select(F.col("place").alias("a"), F.explode("near").alias("b"))
    both = pairs.union(pairs.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    # A pair meets in the block of either one's least neighbour; most often that is the same one.
    meets = both.join(least.withColumnRenamed("a", "c"), F.col("b") == F.col("c")).select("a", "least").union(least.select("a", "least")).distinct()
    leaders = placed.filter("size(leaders) > 0").select(F.col("place").alias("a"), "holds", F.explode("leaders").alias("leader")).select("a", "leader", F.array_contains("holds", F.col("leader")).alias("held"))
    return leaders.union(meets.select("a", -F.col("least") - 1, F.lit(True))).withColumnRenamed("a", "place")


def _link(n: int, similarity: Similarity):
    def work(group: pa.Table) -> pa.Table:
        """Of one block: (a, b, n): n documents more that a is linked to (b null), or a link that joins components."""
        rid, weight = group["rid"].combine_chunks().to_numpy(), group["n"].combine_chunks().to_numpy()
        column = lambda c: group[c].combine_chunks().to_numpy(zero_copy_only=False)
        holds, asks, leader = column("as_held"), column("as_asked"), group["leader"][0].as_py()
        if not holds.any():
            return pa.Table.from_batches([packed([], LINKS)])
        values, at = exact_sets(group["text"].to_pylist(), n)
        size = np.diff(at)
        order = np.lexsort((rid, size))
        values = np.concatenate([values[at[k] : at[k + 1]] for k in order])
        at = np.concatenate([[0], np.cumsum(size[order])])
        rid, weight, holds, asks = rid[order], weight[order], holds[order], asks[order]
        # Blocks before this one: a pair counts in the first in which the one before holds and the other is.
        before = {c: [frozenset(x for x in own if x < leader) for own in group[c].to_pylist()] for c in ("blocks", "held")}
        before = {c: [own[k] for k in order.tolist()] for c, own in before.items()}
        more, parent, out = np.zeros(len(order), np.int64), list(range(len(order))), []
        for k, found in t_queries(values, at, similarity, holds, asks):
            if own := before["blocks"][k]:
                found = found[np.array([own.isdisjoint(before["held"][j]) for j in found.tolist()], bool)]
            more[k] += weight[found].sum()
            more[found] += weight[k]
            out += [(int(rid[a]), int(rid[b]), None) for a, b in join(parent, ((j, k) for j in found.tolist()))]
        out += [(int(rid[k]), None, int(more[k])) for k in np.flatnonzero(more)]
        return pa.Table.from_batches([packed(out, LINKS)])

    return work


def ngram_groups(docs: DataFrame, n: int = 5, percent: int = 80, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, n_shingles, n_links and group (the least rid that links reach, its own included) of every row.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text with fewer than n
    words is one n-gram; one without words, or a null text, has none and is
    linked with nothing. Rows link when 100 * common >= percent * union.
    Repeated rows are documents of their own with equal sets, so they link. A
    null id stays null; an empty table gives an empty table. Links between
    different sets are told by their words; sets are equal if 122 bits of them are.
    A chunk, and so a task, holds the n-grams of some 12 MB of text, or of one longer text.
    """
    prepare(docs.sparkSession)
    docs = pinned(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    rows = rows_of(docs, id=F.col("id"), text=F.col("text"))
    buckets, similarity = buckets or parts_for(rows), Similarity(percent)
    heavy, counts = _heavy(rows, n)
    sent = rows.select("rid", "text").mapInArrow(tidied(_entries(n, similarity, heavy, counts, buckets, HOT)), SENT)
    placed = sent.groupBy("bucket").applyInArrow(tidied_groups(_leaders(similarity)), ANSWER).groupBy("chunk").applyInArrow(tidied_groups(lambda t: _rows(t)), ROW).checkpoint()
    release(docs.sparkSession)
    # One row of each set in a chunk stands for the chunk's others; the first of these goes to blocks, with the number of rows that have it.
    heads = placed.filter("size > 0 and copies > 0").select("set", "size", "rid", "place", "copies")
    classes = heads.groupBy("set", "size").agg(F.min("rid").alias("rid"), F.min("place").alias("place"), F.sum("copies").alias("n")).checkpoint()
    asked = _blocks(placed).join(classes.select("rid", "n", "place", "size"), "place").drop("place").checkpoint()
    # Of a block with very many documents, parts of those that hold meet parts of those that ask, each pair of parts in a block of its own.
    held = F.col("held").cast("long")
    many = asked.groupBy("leader").agg(F.count("*").alias("m"), F.sum("size").alias("mg"), F.sum(held).alias("h"), F.sum(held * F.col("size")).alias("hg")).filter("m > 1 and h > 0")
    parts = lambda rows, grams: F.greatest(F.ceil(F.col(rows) / F.lit(BLOCK_ROWS)), F.ceil(F.col(grams) / F.lit(BLOCK_GRAMS))).cast("int")
    asked = looked_up(asked.drop("size"), many.select("leader", parts("h", "hg").alias("hs"), parts("m", "mg").alias("ms")).checkpoint(), ["leader"])
    asked = asked.withColumn("h", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("hs")).cast("int")).withColumn("m", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("ms")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda k: k * F.col("ms") + F.col("m"))
    meets = F.when(F.col("held"), F.array_union(meets, F.transform(F.sequence(F.lit(0), F.col("ms") - 1), lambda k: F.col("h") * F.col("ms") + k))).otherwise(meets)
    asked = asked.groupBy("rid", "n").agg(F.collect_list(F.struct("leader", "held", "h", "m", "ms", meets.alias("pairs"))).alias("b")).checkpoint()
    # Only texts that a block needs are shuffled.
    blocks = parted(rows.select("rid", "text"), asked.select("rid"))[0].join(asked, "rid").select("rid", "n", "text", F.col("b.leader").alias("blocks"), F.expr("filter(b, x -> x.held).leader").alias("held"), F.explode("b").alias("b"))
    blocks = blocks.select("rid", "n", "text", "blocks", "held", "b.leader", F.col("b.held").alias("may"), "b.h", "b.m", "b.ms", F.explode("b.pairs").alias("pair"))
    here = lambda c: F.col(c) == (F.floor(F.col("pair") / F.col("ms")) if c == "h" else F.col("pair") % F.col("ms"))
    blocks = blocks.select("rid", "n", "text", "blocks", "held", "leader", "pair", (F.col("may") & here("h")).alias("as_held"), here("m").alias("as_asked"))
    links = blocks.groupBy("leader", "pair").applyInArrow(tidied_groups(_link(n, similarity)), LINKS).checkpoint()
    release(docs.sparkSession)
    found = components(links.filter("b is not null").select("a", "b")).withColumnsRenamed({"node": "rid", "component": "group"})
    # What is told of a set goes to its first row in each chunk, and from there to the chunk's rows.
    more = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "rid")
    told = classes.join(more, "rid", "left").join(found, "rid", "left").select("set", "size", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("group", "rid").alias("group"))
    told = heads.select("set", "size", F.col("place").alias("head")).join(told, ["set", "size"]).select("head", "n_links", "group")
    out = rows.select("rid", "id").join(placed.select("rid", "size", "head"), "rid").join(told, "head", "left")
    return out.select("rid", "id", F.col("size").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group", "rid").alias("group"))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id of its group; null ids come after all others) and n_links of every row; see ngram_groups."""
    groups = ngram_groups(docs, n, percent, buckets, id_col, text_col).checkpoint()
    least = groups.groupBy("group").agg(F.min("id").alias("component_id")).checkpoint()
    return looked_up(groups, least, ["group"]).select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_links")
