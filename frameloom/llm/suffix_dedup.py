"""Removal of repeated byte strings by suffix arrays built in blocks.

All strings of LENGTH bytes that are equal must meet in one suffix array, and
no array may hold the corpus. So strings are dealt by content: of the short
windows of a string (32 bytes of 96 and more) the one with the least hash is its anchor, and strings
that start next to each other mostly share it, so a document falls into
segments (runs of starts with one anchor), each sent as two hashes. Segments
with equal anchors and equal content need no sorting: all but the first are
repeats. Where segments of one anchor differ, their bytes meet in one block,
whose suffix array tells which of their strings are equal.

The suffix array is built in two stages: suffixes smaller than their successor
are sorted directly, by eight bytes at a time and only among those still tied;
scanning the buckets of first bytes from the least on, each suffix then places
its predecessor if that is larger than it. Adjacent suffixes with LENGTH bytes
in common hold one string; the first of each such run stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, binary, mixed, parts_for, passes, pinned, prepare, release, rows_of, tidied, tidied_groups
from .components import parted
from .substring_dedup import numbered, packed, runs

#: Bytes of an anchor at most, bytes of a block's text, segments of one anchor that one block takes, bytes of frequent strings that a task remembers.
ANCHOR, BLOCK_BYTES, BLOCK_SEGMENTS, HELD_BYTES = 32, 2 << 20, 4096, 32 << 20
_BASE = 0xD1342543DE82EF95
SEGMENTS, LATER, ROWS = 0, 1, 2
SENT = "bucket int, kind int, chunk long, n int, data binary"
ANSWER = "kind int, chunk long, n int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw, at, out = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), 0, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(raw[at : at + size], k))
        at += size
    return out


def anchor_of(length: int) -> int:
    """Bytes of an anchor in strings of `length` bytes: a power of two, a third of the string at most."""
    return min(ANCHOR, 1 << max(0, (length // 3).bit_length() - 1))


def gram_hashes(data: np.ndarray, width: int = ANCHOR) -> np.ndarray:
    """Hash of the `width` bytes (a power of two) from each position on."""
    h, step, factor = LETTERS[data], 1, _BASE
    while step < width:
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), step * 2
    return mixed(h)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The first position of the least of each `width` consecutive values."""
    m, p, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        if len(m) <= step:
            return np.zeros(0, np.int32)
        left, right = m[:-step], m[step:]
        other = right < left
        m, p, have = np.where(other, right, left), np.where(other, p[step:], p[:-step]), have + step
    return p


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of documents in one buffer (offsets from 0): each segment's document, first start in it, last start less first, anchor hash and content hash."""
    none, size_of = np.zeros(0, np.int64), anchor_of(length)
    h = gram_hashes(data, size_of)
    width = length - size_of + 1
    anchor = least(h, width)
    size = np.diff(offsets)
    count = np.maximum(size - length + 1, 0)
    if not count.sum():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    full = np.flatnonzero(count)
    np.add.at(valid, offsets[full], 1)
    np.add.at(valid, offsets[full] + count[full], -1)
    inside = np.cumsum(valid[:-1]).astype(bool)
    new = np.empty(len(anchor), bool)
    new[0], new[1:] = True, anchor[1:] != anchor[:-1]
    new[offsets[full]] = True
    first = np.flatnonzero(new & inside)
    doc = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(anchor)), offsets[doc] + count[doc]) - 1
    past = last + length
    n = (past - first).astype(np.uint64)
    content = n
    # A segment has at most 2 * length - size_of bytes; anchors at so many places from either end lie over every one of them.
    each = -(-(2 * length - size_of) // (2 * size_of))
    for at in (*(np.minimum(first + k * size_of, past - size_of) for k in range(each)), *(np.maximum(past - k * size_of, first) for k in range(each, 0, -1))):
        content = mixed(content * np.uint64(0x9E3779B97F4A7C15) + h[at])
    return doc, first - offsets[doc], last - first, mixed(h[anchor[first]] ^ np.uint64(0x5851F42D4C957F2D)), content


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal intervals that these cover, as pairs; adjacent ones join."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return np.stack([s[new], e[np.append(new[1:] - 1, len(e) - 1)]], 1).astype(np.int64)


# -- the suffix array of a block --------------------------------------------------------------------


def _tied(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places in `order` whose group has more than one member."""
    first, n = runs(group)
    return np.flatnonzero(np.repeat(n > 1, n))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a byte text sorted by their next `depth` bytes, in two stages."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + depth + 16, np.uint8)
    padded[:n] = text
    word = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    # A suffix is smaller than its successor if the first byte that differs from its own is larger; the end is least.
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    following = np.append(text[change[:-1] + 1].astype(np.int16), -1)
    smaller = np.repeat(following > text[change], np.diff(change, prepend=-1))
    direct = np.flatnonzero(smaller)
    order = direct[np.argsort(word[direct], kind="stable")]
    key = word[order]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if len(order) else np.zeros(0, np.int64)
    at = np.arange(len(order))  # places of `order` that may still be tied
    for skip in range(8, depth, 8):
        at = at[_tied(order[at], group[at])] if len(at) else at
        if not len(at):
            break
        key = word[order[at] + skip]
        sorted_ = np.lexsort((key, group[at]))
        order[at], key, g = order[at][sorted_], key[sorted_], group[at]
        # Groups that split: numbers stay rising, as a group has as many numbers of its own as members.
        split = np.concatenate([[0], ((key[1:] != key[:-1]) | (g[1:] != g[:-1])).astype(np.int64)])
        group[at] = np.cumsum(split) + 1
    # The buckets, from the least first byte on.
    begin = np.searchsorted(text[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and not smaller[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        own = [x for x in waiting[c] if len(x)]
        new = np.concatenate(own) if own else np.zeros(0, np.int64)
        own = [new] if len(new) else []
        while len(new):  # predecessors in the bucket itself
            new = new[new > 0] - 1
            new = new[text[new] == c]
            if len(new):
                own.append(new)
        if begin[c + 1] > begin[c]:
            own.append(order[begin[c] : begin[c + 1]])
        if not own:
            continue
        bucket = np.concatenate(own)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            by = text[before]
            before = before[np.argsort(by, kind="stable")]
            by = np.sort(by)
            first, _ = runs(by)
            for lo, hi in zip(first, np.append(first[1:], len(by)), strict=True):
                waiting[by[lo]].append(before[lo:hi])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def later(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some byte strings, in their order, the starts at which a string of `length` bytes has started before."""
    joined = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)  # no UTF-8 text holds this byte
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    owner = np.repeat(np.arange(len(texts)), size + 1)
    whole = np.arange(len(joined)) - begin[owner] + length <= size[owner]
    found = suffix_array(joined, length)
    found = found[whole[found]]
    # Common prefixes of adjacent suffixes, as far as `length`.
    common = np.zeros(max(0, len(found) - 1), np.int64)
    alive = np.arange(len(common))
    a, b = found[:-1], found[1:]
    for k in range(length):
        alive = alive[joined[a[alive] + k] == joined[b[alive] + k]]
        common[alive] += 1
        if not len(alive):
            break
    same = np.concatenate([[0], np.cumsum(common < length)]) if len(found) else np.zeros(0, np.int64)
    first, n = runs(same)
    least_ = np.minimum.reduceat(found, first) if len(first) else np.zeros(0, np.int64)
    again = np.sort(found[found != np.repeat(least_, n)])
    cut = np.searchsorted(owner[again], np.arange(len(texts) + 1))
    return [again[cut[k] : cut[k + 1]] - begin[k] for k in range(len(texts))]


# -- the operator -----------------------------------------------------------------------------------

_ENTRY = ("<i8", "<i4", "<i4", "<u4", "<u8", "<u8")  # distance to the last doc_id, row in the chunk, start, last less first start, anchor, content
_BACK = ("<i4", "<i4", "<u4")
PART = "block int, anchor long, id long, rid long, start long, data binary"


def _send(length: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in numbered(batches):
            part = part.sort_by([("id", "ascending"), ("rid", "ascending")])  # nulls last
            ids = part["id"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
            data, offsets = binary(part["text"])
            found = []
            for lo, hi in passes(offsets):
                own = segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                found.append((own[0] + lo, *own[1:]))
            row, start, extra, anchor, content = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
            yield packed([(chunk % buckets, ROWS, chunk, len(ids), pack(part["rid"].combine_chunks().to_numpy()))], SENT)
            if not len(row):
                continue
            # Of equal segments in the chunk only the first is sent.
            order = np.lexsort((np.arange(len(row)), content, anchor))
            repeat = np.concatenate([[False], (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])])
            again = np.sort(order[repeat])
            if len(again):
                yield packed([(chunk % buckets, LATER, chunk, len(again), pack(row[again].astype("<i4"), start[again].astype("<i4"), extra[again].astype("<u4")))], SENT)
            once = np.sort(order[~repeat])
            bucket = ((anchor[once] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                k = once[by[at[b] : at[b + 1]]]
                if len(k):
                    doc = np.diff(ids[row[k]], prepend=np.int64(0))
                    yield packed([(b, SEGMENTS, chunk, len(k), pack(doc, row[k].astype("<i4"), start[k].astype("<i4"), extra[k].astype("<u4"), anchor[k], content[k]))], SENT)

    return work


def _compare(group: pa.Table) -> pa.Table:
    """For each chunk, its segments that are repeats as a whole, and those to be compared byte by byte with others of their anchor."""
    kind = group["kind"].to_numpy()
    passed = group.filter(pa.array(kind != SEGMENTS)).select(["kind", "chunk", "n", "data"])
    group = group.filter(pa.array(kind == SEGMENTS))
    if not len(group):
        return passed
    of_chunk, sizes = group["chunk"].to_numpy(), group["n"].to_numpy()
    parts = [unpack(d.as_py(), n, *_ENTRY) for d, n in zip(group["data"], sizes.tolist(), strict=True)]
    doc = np.concatenate([np.cumsum(p[0]) for p in parts])
    row, start, extra, anchor, content = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
    which = np.repeat(np.arange(len(parts)), sizes)
    chunk = of_chunk[which]
    order = np.argsort(anchor, kind="stable")
    first, n = runs(anchor[order])
    order = order[np.repeat(n > 1, n)]
    order = order[np.lexsort((start[order], row[order], chunk[order], doc[order], content[order], anchor[order]))]
    a, c = anchor[order], content[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    head = new_anchor | np.concatenate([[True], c[1:] != c[:-1]]) if len(a) else new_anchor
    kinds_of = np.add.reduceat(head.astype(np.int64), np.flatnonzero(new_anchor)) if len(a) else np.zeros(0, np.int64)
    differing = kinds_of[np.cumsum(new_anchor) - 1] if len(a) else kinds_of
    out = []
    for what, mask in ((LATER, ~head), (SEGMENTS, head & (differing > 1))):
        chosen, number = order[mask], differing[mask]
        by = np.argsort(which[chosen], kind="stable")
        chosen, number = chosen[by], number[by]
        for lo, size in zip(*runs(which[chosen]), strict=True):
            k = chosen[lo : lo + size]
            back = [row[k], start[k], extra[k]]
            out.append((what, int(chunk[k[0]]), len(k), pack(*back) if what == LATER else pack(*back, anchor[k], number[lo : lo + size].astype("<i8"))))
    return pa.concat_tables([passed, pa.Table.from_batches([packed(out, ANSWER)])])


def _gather(length: int):
    def work(group: pa.Table) -> pa.Table:
        """Per row of a chunk: the intervals to remove, and the segments to compare (start, past, anchor, how many differ)."""
        kind, sizes, data = group["kind"].to_pylist(), group["n"].to_pylist(), group["data"]
        k = kind.index(ROWS)
        rids = unpack(data[k].as_py(), sizes[k], "<i8")[0]
        out: dict[int, list] = {}
        for what, kinds in ((LATER, _BACK), (SEGMENTS, (*_BACK, "<u8", "<i8"))):
            parts = [unpack(data[j].as_py(), sizes[j], *kinds) for j, x in enumerate(kind) if x == what]
            if not parts:
                continue
            row, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(row, kind="stable")
            row, (start, extra, *more) = row[by], [x[by] for x in rest]
            past = start.astype(np.int64) + extra + length
            for lo, n in zip(*runs(row), strict=True):
                s = slice(lo, lo + n)
                own = out.setdefault(int(rids[row[lo]]), [None, None])
                if what == LATER:
                    own[0] = merged(start[s].astype(np.int64), past[s]).tobytes()
                else:
                    own[1] = np.stack([start[s].astype(np.int64), past[s], more[0][s].view(np.int64), more[1][s]], 1).tobytes()
        return pa.Table.from_batches([packed([(r, *v) for r, v in out.items()], "rid long, spans binary, asked binary")])

    return work


def _bytes_of(length: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the segments asked for.

        Of an anchor with very many, each block gets the strings whose hash
        falls to it; of those that this task holds several times only the
        first is sent as bytes, the others as repeats (no data, anchor: their end).
        """
        earliest: dict[tuple[int, bytes], tuple] = {}
        held, size_of = 0, anchor_of(length)

        def firsts() -> Iterator[pa.RecordBatch]:
            rest = [(block, key, None if null else id_, rid, start, own) for (key, own), (null, id_, rid, start, block) in earliest.items()]
            for lo in range(0, len(rest), 4096):
                yield packed(rest[lo : lo + 4096], PART)
            earliest.clear()

        for batch in batches:
            out = []
            if held > HELD_BYTES:  # what comes later starts anew; blocks compare all bytes that they get
                yield from firsts()
                held = 0
            for rid, id_, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for start, past, anchor, number in np.frombuffer(asked, np.int64).reshape(-1, 4).tolist():
                    block = (((anchor & (1 << 64) - 1) >> 32) * buckets) >> 32
                    if number <= BLOCK_SEGMENTS:
                        out.append((block, anchor, id_, rid, start, data[start:past]))
                        continue
                    ways = math.ceil(number / (BLOCK_SEGMENTS // 8))
                    part = np.frombuffer(data[start:past], np.uint8)
                    h = gram_hashes(part, size_of)
                    n = past - start - length + 1
                    way = np.zeros(n, np.uint64)
                    for k in (*range(0, length - size_of, size_of), length - size_of):
                        way = mixed(way + h[k : k + n])
                    way = (way % np.uint64(ways)).astype(np.int64)
                    for lo, size in zip(*(x.tolist() for x in runs(way)), strict=True):
                        own = data[start + lo : start + lo + size + length - 1]
                        key, now = (anchor ^ (int(way[lo]) + 1), own), (id_ is None, id_ or 0, rid, start + lo, (block + 1 + int(way[lo])) % buckets)
                        held += 0 if key in earliest else len(own)
                        first, last = sorted((earliest.get(key, now), now))
                        earliest[key] = first
                        if first != last:
                            out.append((last[2] % buckets, last[3] + len(own), None, last[2], last[3], None))
            for lo in range(0, len(out), 4096):
                yield packed(out[lo : lo + 4096], PART)
        yield from firsts()

    return work


def _blocks(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads the segments of a block by anchor and sorts the suffixes of some anchors at a time."""

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
            spans: dict[int, list] = {}
            for (_, _, rid, start, _), again in zip(rows, later([r[4] for r in rows], length), strict=True):
                if len(again):
                    spans.setdefault(rid, []).append(merged(again + start, again + start + length))
            out = [(rid, (m := np.concatenate(x)) is not None and merged(m[:, 0], m[:, 1]).tobytes()) for rid, x in spans.items()]
            return packed(out, "rid long, spans binary")

        held, size = [], 0
        for batch in batches:
            known = []
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if row[4] is None:
                    known.append((row[2], np.array([row[3], row[0]], np.int64).tobytes()))
                    continue
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
            if known:
                yield packed(known, "rid long, spans binary")
        if held:
            yield solve(held)

    return work


def _joined(group: pa.Table) -> pa.Table:
    both = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for x in group["spans"]])
    return pa.Table.from_batches([packed([(group["rid"][0].as_py(), merged(both[:, 0], both[:, 1]).tobytes())], "rid long, spans binary")])


def repeated_bytes(docs: DataFrame, length: int, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, id, text, rest: a struct of the extra columns) and their intervals to remove (rid, spans; several rows of one rid may overlap)."""
    prepare(docs.sparkSession)
    rest = [F.col(c) for c in extra] or [F.lit(None).cast("int").alias("none")]
    docs = pinned(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*rest).alias("rest")))
    full = rows_of(docs, id=F.col("id"), text=F.col("text"), rest=F.col("rest"))
    rows = full.select("rid", "text", "id")
    buckets = buckets or parts_for(rows)
    sent = rows.mapInArrow(tidied(_send(length, buckets)), SENT)
    answers = sent.groupBy("bucket").applyInArrow(tidied_groups(lambda t: _compare(t)), ANSWER)
    gathered = answers.groupBy("chunk").applyInArrow(tidied_groups(_gather(length)), "rid long, spans binary, asked binary").checkpoint()
    release(docs.sparkSession)
    asks = gathered.filter("asked is not null").select("rid", "asked")
    asked = parted(rows, asks.select("rid"))[0].join(asks, "rid").select("rid", "id", "text", "asked")
    parts = asked.mapInArrow(tidied(_bytes_of(length, buckets)), PART)
    dealt = parts.repartition(buckets, "block").sortWithinPartitions("block", "anchor")
    spans = dealt.mapInArrow(tidied(_blocks(length)), "rid long, spans binary")
    return full, gathered.filter("spans is not null").select("rid", "spans").unionByName(spans)


def remove_repeated_bytes(docs: DataFrame, length: int = 100, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, spans and kept of every row; spans are pairs (first byte, past the last).

    A byte goes if it is covered by a string of `length` bytes that also starts
    earlier: at a smaller id, or in the same document before; rows of one id
    come in the order of the table, and null ids last; ids are whole numbers. kept is the rest as
    bytes, which need not be UTF-8 any more. Texts shorter than `length` and
    null (empty) texts stay; an empty table gives an empty table. Segments of over `length` bytes
    that share an anchor and a 64-bit hash of their bytes are taken for equal; all others are compared byte by byte.
    The columns named in `extra` follow. as_text gives kept as a string, without
    what is left of characters that were cut in two.
    """
    if length < 1:
        raise ValueError("length must be 1 or more")
    rows, spans = repeated_bytes(docs, length, buckets, id_col, text_col, extra)
    spans = spans.groupBy("rid").applyInArrow(lambda t: _joined(t), "rid long, spans binary").checkpoint()
    release(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                own, out = batch.slice(lo, 512), []
                for text, found in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True):
                    data = (text or "").encode()
                    pairs = np.frombuffer(found or b"", np.int64).reshape(-1, 2).tolist()
                    kept, at = [], 0
                    for first, past in pairs:
                        kept.append(data[at:first])
                        at = past
                    kept = b"".join([*kept, data[at:]])
                    out.append((len(data), len(data) - len(kept), pairs, kept.decode(errors="ignore") if as_text else kept))
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string() if as_text else pa.binary()))), *([own.column(3)] if extra else [])], ["id", "n_bytes", "n_removed", "spans", "kept"] + ["rest"] * bool(extra))

    told = "id long, n_bytes long, n_removed long, spans array<array<bigint>>, kept " + ("string" if as_text else "binary") + f", rest {dict(rows.dtypes)['rest']}" * bool(extra)
    # Texts of which nothing goes stay where they are.
    columns = ["id", "text", "spans", *["rest"] * bool(extra)]
    some, others = parted(rows, spans.select("rid"))
    out = some.join(spans, "rid").select(columns).unionByName(others.withColumn("spans", F.lit(None).cast("binary")).select(columns)).mapInArrow(tidied(cut), told)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept", *[F.col("rest")[c].alias(c) for c in extra])
