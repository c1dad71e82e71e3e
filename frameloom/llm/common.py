"""What the corpus operators share: sessions, shared folders, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import math
import re
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
PASS_BYTES = (2 << 20) - 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, keeps scans alike, and names a checkpoint folder if the session has none.

    Spark cuts files by the number of cores present unless that is fixed;
    executors that go or come between two jobs would change which task reads
    which row, and rows are numbered by that. A folder of this machine is only
    named in local mode: on a cluster, executors could not share it.
    """
    root = str(Path(__file__).resolve().parents[2])
    context = spark.sparkContext
    env = context.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(context.defaultParallelism))
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="frameloom-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)


def pinned(df: DataFrame) -> DataFrame:
    """df, or its checkpoint if a second reading could deal its rows otherwise.

    A plain scan of files gives the same partitions and rows each time, and so
    it does if a broadcast table tells which of its rows stay (`components.parted`); what
    comes out of a shuffle or a generator may not.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steady = {"Project", "Filter", "Relation", "LogicalRelation", "RelationV2", "LogicalRDD", "Union"}
    nodes = [(m[1], line) for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*(\w+)", line))]
    same = all(node in steady or node == "Join" and re.search(r"Join (LeftOuter|Inner), .*rightHint=\(strategy=broadcast\)", line) for node, line in nodes)
    return df if same else df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done and whose results are checkpointed.

    Spark deletes them once the driver's collector finds that nothing uses them, which
    on a driver with free memory is when the disk has long been full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_of(docs: DataFrame, **columns: Column) -> DataFrame:
    """The named columns and `rid`, a number of each row that every reading of docs repeats."""
    return docs.select(*[c.alias(k) for k, c in columns.items()]).withColumn("rid", F.monotonically_increasing_id())


def parts_for(df: DataFrame, each_mb: float = 10.0) -> int:
    """Partitions such that each stands for about each_mb of scanned files; at least the session's."""
    plan = df._jdf.queryExecution().optimizedPlan()
    known = int(plan.stats().sizeInBytes())
    if known >= 1 << 45 or "Join " in plan.toString():  # Spark does not know it, as of rows that come from a checkpoint; for joins it multiplies
        known = df.count() << 12
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(known / (each_mb * 1e6)))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and the offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes, or of one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_tidied = 0.0


def tidy(every_s: float = 0.0) -> None:
    """Gives memory that is free in this process back to the system; workers stay, and would hold what their largest task took. Not again within every_s."""
    global _tidied
    if time.monotonic() - _tidied >= every_s:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)
        _tidied = time.monotonic()


def tidied(work: Callable) -> Callable:
    """work over batches, which leaves no free memory behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        tidy()

    return run


def tidied_groups(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """work over groups, with free memory given back every second."""

    def run(group: pa.Table) -> pa.Table:
        out = work(group)
        tidy(1.0)
        return out

    return run


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


# -- hashes of bytes and words ----------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
#: A random odd value for each byte.
LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes with A-Z taken as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The lowest 0 to 8 bytes of a 64-bit value.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time; longer words take blake2b.
_LONG_WORD = 64
#: The modulus of Rabin-Karp hashes, a prime, and two independent pairs of a key for words and a base for windows.
PRIME = (1 << 61) - 1
KEYS = ((0x5BD1E995C2B2AE35, 0x0D1342543DE82EF95 % PRIME), (0x9FB21C651E98DF25, 0x1F251AF3B0F025B5 % PRIME))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (the splitmix64 finaliser, a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def product(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME; both are below it. Halves of 31 bits, as 2 ** 61 is 1."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    middle = a1 * b0 + a0 * b1
    carried = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31))
    return _reduced(_reduced(np.uint64(2) * a1 * b1 + carried) + _reduced(a0 * b0))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each document, and each document's first word; offsets begin at 0."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[full] = inside[full]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, folded: bool = False, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A keyed 64-bit hash for each word, and each document's first word.

    Eight bytes at a time go through `mixed`, from a state that the key and the
    word's length give; a word of over _LONG_WORD bytes takes blake2b.
    """
    starts, ends, at = words(data, offsets)
    size = ends - starts
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = LOWER[data] if folded else data
    eight = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
    h = mixed(size.astype(np.uint64) ^ np.uint64(KEYS[key][0]))
    short = np.flatnonzero(size <= _LONG_WORD)
    for k in range(0, _LONG_WORD, 8):
        short = short[size[short] > k]
        if not len(short):
            break
        h[short] = mixed(h[short] ^ (eight[starts[short] + k] & _LOWEST[np.minimum(size[short] - k, 8)]))
    secret = KEYS[key][0].to_bytes(8, "little")
    for w in np.flatnonzero(size > _LONG_WORD).tolist():
        h[w] = int.from_bytes(hashlib.blake2b(padded[starts[w] : ends[w]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return h, at


def rolling(values: np.ndarray, k: int, key: int = 0) -> np.ndarray:
    """Rabin-Karp hash, modulo PRIME and then mixed, of each k consecutive values; by doubling, so no table of powers is held."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    n, base = len(values) - k + 1, KEYS[key][1]
    h, step, out, done = _reduced(values), 1, None, 0
    while True:
        if k & step:  # the next `step` values of the window
            out, done = (h[:n] if out is None else _reduced(product(out, pow(base, step, PRIME)) + h[done : done + n])), done + step
        if done == k:
            return mixed(out)
        h, step = _reduced(product(h[:-step], pow(base, step, PRIME)) + h[step:]), 2 * step


def short_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """Hash of values[start:end] for spans of a few values, their number included."""
    size = ends - starts
    h = size.astype(np.uint64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        h[more] = mixed(h[more] ^ values[starts[more] + k] ^ np.uint64(KEYS[key][1]))
    return h
