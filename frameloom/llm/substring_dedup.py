"""Removal of repeated word windows: Rabin-Karp hashes of every window, counted in Spark.

The hash of every window of `window` words is sent, with its place, to the
partition that counts it. Hashes travel as packed arrays (6 bytes for the hash
and 2 for the distance to the last place of the same array), one array per
chunk of documents and counting bucket, so a window costs some eight bytes of
shuffle. A hash that a chunk holds more than once is known there to be
repeated: it travels once, without a place, and a hot passage therefore
reaches its bucket at most once per chunk. Buckets answer each chunk with the
places whose hash they counted more than once.

48 bits are a filter, not a proof: among 10 ** 13 windows a few in a hundred
share them by chance. So the windows found are counted again by two
independent hashes of their words together (122 bits, other word keys and
other bases), and only those that repeat by both go. Both rounds read the
same shuffle of the texts. What is left merges into maximal intervals of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, parts_for, passes, pinned, prepare, rolling, rows_of, word_hashes

#: Bytes of text in a chunk: enough that a chunk has many windows for each bucket.
CHUNK_BYTES, CHUNK_ROWS = 12 << 20, 1 << 18
#: What travels: hashes to be counted with their places, places found repeated, and a chunk's rows with their first places.
HASHES, PLACES, ROWS = 0, 1, 2
SENT = "bucket int, kind int, chunk long, hashes binary, gaps binary, twice binary"
ANSWER = "kind int, chunk long, hashes binary, gaps binary"


def runs(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    return first, np.diff(np.append(first, len(order)))


def gaps(places: np.ndarray) -> bytes:
    """Rising places as two-byte distances; 0 stands for 65,535 places without one."""
    if not len(places):
        return b""
    d = np.diff(places, prepend=-1)
    far = (d - 1) // 65535
    out = np.zeros(len(d) + int(far.sum()), np.uint16)
    out[np.cumsum(far) + np.arange(len(d))] = d - far * 65535
    return out.tobytes()


def ungap(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, np.uint16).astype(np.int64)
    return (np.cumsum(np.where(d == 0, 65535, d)) - 1)[d > 0]


#: Bits of a hash that the first round keeps.
FILTER = np.uint64(((1 << 48) - 1) << 16)


def to_bytes(h: np.ndarray) -> bytes:
    """Rows of hashes; of a single one the 48 bits that FILTER keeps."""
    if h.shape[1] > 1:
        return h.tobytes()
    return np.ascontiguousarray((h[:, 0] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_bytes(data: bytes | None, width: int) -> np.ndarray:
    if width > 1:
        return np.frombuffer(data or b"", np.uint64).reshape(-1, width)
    six = np.frombuffer(data or b"", np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, 2:] = six
    return eight.reshape(-1).view(np.uint64).reshape(-1, 1)


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows of hashes, and the first place and the length of each run of equal rows in it."""
    order = np.argsort(h[:, 0], kind="stable") if h.shape[1] == 1 else np.lexsort(h.T[::-1])
    if not len(h):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = h[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return order, first, np.diff(np.append(first, len(h)))


def send(chunk: int, h: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[tuple]:
    """What a chunk sends of the windows with these rows of hashes at these places."""
    by_hash, first, n = ranked(h)
    once = by_hash[first[n == 1]]
    once.sort()
    twice = h[by_hash[first[n > 1]]]
    own = np.sort(by_hash[np.repeat(n > 1, n)])
    if len(own):
        yield (chunk % buckets, PLACES, chunk, None, gaps(places[own]), None)
    # The upper bits choose the bucket.
    bucket_of = lambda x: ((x[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    b1, b2 = bucket_of(h[once]), bucket_of(twice)
    o1, o2 = np.argsort(b1, kind="stable"), np.argsort(b2, kind="stable")
    at1, at2 = np.searchsorted(b1[o1], np.arange(buckets + 1)), np.searchsorted(b2[o2], np.arange(buckets + 1))
    for b in range(buckets):
        p, q = once[o1[at1[b] : at1[b + 1]]], twice[o2[at2[b] : at2[b + 1]]]
        if len(p) or len(q):
            yield (b, HASHES, chunk, to_bytes(h[p]), gaps(places[p]), to_bytes(q))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The chunks of a task with their numbers, below 2 ** 43 for up to 2 ** 23 tasks of up to 2 ** 20 chunks (12 TB of text)."""
    for k, part in enumerate(chunks(batches)):
        yield TaskContext.get().partitionId() << 20 | k, part


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of whole rows, at most CHUNK_ROWS, with at most about `limit` bytes of text; text is column 1."""
    held, size, rows = [], 0, 0
    for batch in batches:
        lo = 0
        _, offsets = binary(batch.column(1))
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit - size, "right")) - 1)
            hi = min(hi, lo + CHUNK_ROWS - rows)
            rows += hi - lo
            held.append(batch.slice(lo, hi - lo))
            size += int(offsets[hi] - offsets[lo])
            lo = hi
            if size >= limit - (limit >> 4) or rows >= CHUNK_ROWS or lo < len(batch):
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def count(width: int):
    def work(group: pa.Table) -> pa.Table:
        """The answer of one bucket: for each chunk, the places whose `width` hashes occur again anywhere. Other rows pass."""
        kind = group["kind"].to_numpy()
        passed = group.filter(pa.array(kind != HASHES)).select(["kind", "chunk", "hashes", "gaps"])
        group = group.filter(pa.array(kind == HASHES))
        hashes, twice = ([from_bytes(x.as_py(), width) for x in group[c]] for c in ("hashes", "twice"))
        n = np.array([len(x) for x in hashes], np.int64)
        every = np.concatenate([np.zeros((0, width), np.uint64), *hashes, *twice])
        by_hash, first, size = ranked(every)
        # A hash that any chunk sent as repeated counts as repeated.
        again = np.zeros(len(every), bool)
        again[by_hash[np.repeat((size > 1) | (np.maximum.reduceat(by_hash, first) >= n.sum() if len(first) else False), size)]] = True
        out, at = [], 0
        for k, chunk in enumerate(group["chunk"].to_pylist()):
            mine = again[at : at + n[k]]
            at += n[k]
            if mine.any():
                out.append((PLACES, chunk, None, gaps(ungap(group["gaps"][k].as_py())[mine])))
        return pa.concat_tables([passed, pa.Table.from_batches([packed(out, ANSWER)])])

    return work


def packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [f for f, _ in fields])


def _hashes(window: int, buckets: int, keys: tuple[int, ...]):
    """Sends the hashes, by each of `keys`, of all windows, or of those that start at the words of a third column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in numbered(batches):
            data, offsets = binary(part.column(1))
            hashes: list[list[np.ndarray]] = [[] for _ in keys]
            starts = [0]
            for lo, hi in passes(offsets):
                for k, own in zip(keys, hashes, strict=True):
                    h, at = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], key=k)
                    own.append(h)
                starts += (at[1:] + starts[lo]).tolist()
            at = np.array(starts, np.int64)
            h = np.stack([rolling(np.concatenate(own), window, k) for k, own in zip(keys, hashes, strict=True)], 1)
            if len(keys) == 1:
                h &= FILTER
            if part.num_columns > 2:
                places = np.concatenate([ungap(x.as_py()) + at[k] for k, x in enumerate(part.column(2))])
            else:  # windows that end in the document in which they start
                places = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(at[1:], np.diff(at))[: len(h)])
            yield packed([(chunk % buckets, ROWS, chunk, at.tobytes(), part.column(0).combine_chunks().to_numpy().tobytes(), None)], SENT)
            for row in send(chunk, h[places], places, buckets):
                yield packed([row], SENT)

    return work


def _told(window: int, merge: bool):
    """Of each row of a chunk with repeated windows: where they start (gaps), or the maximal intervals that they cover."""

    def work(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_pylist()
        k = kind.index(ROWS)
        at, rids = np.frombuffer(group["hashes"][k].as_py(), np.int64), np.frombuffer(group["gaps"][k].as_py(), np.int64)
        found = [ungap(x.as_py()) for x, b in zip(group["gaps"], kind, strict=True) if b == PLACES]
        starts = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        row = np.searchsorted(at, starts, "right") - 1
        out = []
        for first, n in zip(*runs(row), strict=True):
            own = starts[first : first + n] - at[row[first]]
            if merge:
                new = np.flatnonzero(np.concatenate([[True], own[1:] > own[:-1] + window]))
                spans = np.stack([own[new], np.append(own[new[1:] - 1], own[-1]) + window], 1).astype(np.int64).tobytes()
            out.append((int(rids[row[first]]), spans if merge else gaps(own)))
        return pa.Table.from_batches([packed(out, "rid long, spans binary")])

    return work


def repeated_windows(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """rid, spans: the maximal intervals of words (pairs of int64: first, past the last) that repeated windows cover."""

    def counted(texts: DataFrame, keys: tuple[int, ...], merge: bool) -> DataFrame:
        sent = texts.mapInArrow(_hashes(window, buckets, keys), SENT)
        return sent.groupBy("bucket").applyInArrow(count(len(keys)), ANSWER).groupBy("chunk").applyInArrow(_told(window, merge), "rid long, spans binary")

    likely = counted(rows.select("rid", "text"), (0,), merge=False).checkpoint()
    # All columns of rows, so that this and the last join read one shuffle of the texts.
    asked = rows.join(likely, "rid").select("rid", "text", F.col("spans").alias("starts"), *[c for c in rows.columns if c not in ("rid", "text")])
    return counted(asked, (0, 1), merge=True)


def remove_repeats(docs: DataFrame, window: int = 50, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans and kept of every row.

    Words are [^\\x20\\x09-\\x0D]+. Every word that is covered by a window of
    `window` words whose sequence also starts elsewhere, in any row or in the
    same one, goes. spans are the maximal intervals of words that go (pairs
    first, past the last), kept the other words joined by one space. Equality
    of sequences is that of 122 bits of two independent hashes. Repeated rows are documents of
    their own, so both of them go; a null text has no words and its kept is
    empty; texts shorter than a window stay; null ids stay null; an empty
    table gives an empty table.
    """
    prepare(docs.sparkSession)
    docs = pinned(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    rows = rows_of(docs, id=F.col("id"), text=F.col("text"))
    spans = repeated_windows(rows, window, buckets or parts_for(rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                out = []
                own = batch.slice(lo, 512)
                for text, found in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True):
                    split = (text or "").encode().split()  # of bytes: at \x20 and \x09-\x0D only
                    pairs = np.frombuffer(found or b"", np.int64).reshape(-1, 2).tolist()
                    kept, at = [], 0
                    for first, past in pairs:
                        kept += split[at:first]
                        at = past
                    kept += split[at:]
                    out.append((len(split), len(split) - len(kept), pairs, b" ".join(kept).decode()))
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())))], ["id", "n_words", "n_removed", "spans", "kept"])

    kind = dict(docs.dtypes)["id"]
    return rows.join(spans, "rid", "left").select("id", "text", "spans").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, spans array<array<bigint>>, kept string").withColumnRenamed("id", id_col)
