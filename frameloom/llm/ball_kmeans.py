"""Ball k-means on whole numbers: clusters are balls, and members are compared with the centroids that a ball can lose them to.

A ball is a centroid and the greatest distance of its members. A centroid j
is a neighbour of ball i if the half way to it lies inside the ball, d(i, j)
<= 2 * radius; no other centroid can win a member. Neighbours are sorted by
their distance, and cut the ball into a stable core, nearer than half way to
the first neighbour, and annuli: a member of the m-th annulus is compared
with the first m neighbours only. A pair of centroids that stand still is not
compared again. All comparisons are of squared distances of whole numbers, so
the clusters are exactly those of comparing all centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, prepare

#: Rounds that are applied to vectors in memory before they are written with their clusters.
ROUNDS_BETWEEN_WRITES = 4
#: Components of vectors are packed at the narrowest of these.
WIDTHS = (np.int16, np.int32, np.int64)


@dataclass
class Step:
    """The centroids of a round, which of them have moved, and each one's neighbours with their squared distance, nearest first; None: compare all."""

    centroids: list[list[int]]
    moved: list[bool]
    neighbours: list[list[tuple[int, int]]] | None


def packed(vectors: np.ndarray, scale: int) -> list[bytes]:
    """floor(scale * x) of each row as whole numbers of the row's width."""
    whole = np.floor(vectors * scale)
    if len(whole) and np.abs(whole).max() >= 2.0**62:
        raise ValueError("scaled components must be below 2**62")
    whole = whole.astype(np.int64)
    most = np.abs(whole).max(axis=1, initial=0)
    width = np.searchsorted([1 << 15, 1 << 31], most, "right")
    return [row.astype(WIDTHS[w]).tobytes() for row, w in zip(whole, width.tolist(), strict=True)]


def unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """A matrix of whole numbers, of one or of several widths."""
    rows = column.to_pylist()
    out = np.empty((len(rows), dimension), np.int64)
    size = np.array([len(r) // dimension for r in rows])
    for w in WIDTHS:
        at = np.flatnonzero(size == np.dtype(w).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join([rows[k] for k in at.tolist()]), w).reshape(-1, dimension)
    return out


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((x - centroid) ** 2).sum(axis=1)


def compare_all(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each row."""
    best, own = squared(x, centroids[0]), np.zeros(len(x), np.int64)
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        nearer = d < best
        best[nearer], own[nearer] = d[nearer], j
    return own, best


def compare_balls(x: np.ndarray, own: np.ndarray, d: np.ndarray, step: Step, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the clusters and distances of the round before, ball by ball."""
    after, best = own.copy(), d.copy()
    for i in np.unique(own).tolist():
        rows = np.flatnonzero(own == i)
        mine = squared(x[rows], centroids[i]) if step.moved[i] else d[rows]
        best[rows] = mine
        for j, apart in step.neighbours[i]:
            outside = 4 * mine >= apart  # not in the core, and in this annulus or a later one
            if not outside.any():
                break
            if not (step.moved[i] or step.moved[j]):
                continue
            near = rows[outside]
            other = squared(x[near], centroids[j])
            wins = (other < best[near]) | ((other == best[near]) & (j < after[near]))
            after[near[wins]], best[near[wins]] = j, other[wins]
    return after, best


def applied(batch: pa.RecordBatch, steps: list[Step], dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, clusters and squared distances of a batch (id, v, cluster, distance) after some rounds."""
    x = unpacked(batch.column(1), dimension)
    own, d = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(3).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    # Four times a squared distance must fit 63 bits; beyond that, Python's whole numbers are used.
    limit = math.isqrt((1 << 63) // (16 * max(1, dimension))) - 1
    wide = (len(x) and int(np.abs(x).max(initial=0)) > limit) or any(abs(c) > limit for s in steps for row in s.centroids for c in row)
    if wide:
        x, d = x.astype(object), d.astype(object)
    for s in steps:
        centroids = np.array(s.centroids, dtype=object if wide else np.int64)
        own, d = compare_all(x, centroids) if s.neighbours is None else compare_balls(x, own, d, s, centroids)
    if wide and len(d) and max(d) >= 1 << 63:
        raise ValueError("a squared distance does not fit a long")
    return x, own, d


def assigned(vectors: DataFrame, steps: list[Step], dimension: int) -> DataFrame:
    """(id, v, cluster, distance) after some rounds."""
    schema = vectors.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, own, d = applied(batch, steps, dimension)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(d.tolist(), pa.int64())], ["id", "v", "cluster", "distance"])

    return vectors.mapInArrow(work, schema)


def totals(vectors: DataFrame, steps: list[Step], dimension: int) -> dict[int, tuple[int, int, list[int]]]:
    """Per cluster the number of members, the greatest squared distance and the sum of each component: k * dimension numbers from each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = {}, {}, {}
        for batch in batches:
            x, own, d = applied(batch, steps, dimension)
            for i in np.unique(own).tolist():
                rows = np.flatnonzero(own == i)
                n[i] = n.get(i, 0) + len(rows)
                far[i] = max(far.get(i, 0), int(d[rows].max()))
                sums[i] = [a + int(b) for a, b in zip(sums.get(i, [0] * dimension), x[rows].sum(axis=0), strict=True)]
        if n:
            cells = [(i, k, v) for i in n for k, v in enumerate([n[i], far[i], *sums[i]])]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.decimal128(38, 0))], ["cluster", "part", "value"])

    cells = mapped(vectors, work, "cluster int, part int, value decimal(38,0)").groupBy("cluster", "part").agg(F.sum("value").cast("decimal(38,0)").alias("s"), F.max("value").alias("m"))
    found: dict[int, list[int]] = {}
    for r in cells.collect():
        found.setdefault(r["cluster"], [0] * (dimension + 2))[r["part"]] = int(r["m"] if r["part"] == 1 else r["s"])
    return {i: (v[0], v[1], v[2:]) for i, v in found.items()}


def next_step(centroids: list[list[int]], found: dict[int, tuple[int, int, list[int]]]) -> Step:
    """Centroids at the floors of their members' means, with the neighbours of each ball."""
    new = [[s // found[i][0] for s in found[i][2]] if i in found else c for i, c in enumerate(centroids)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    apart = [[gap(a, b) for b in new] for a in new]
    neighbours = []
    for i in range(len(new)):
        # The radius about the new centroid is at most the old one and the way that the centroid went.
        radius = math.isqrt(found[i][1]) + math.isqrt(gap(centroids[i], new[i])) + 2 if i in found else 0
        neighbours.append(sorted(((j, apart[i][j]) for j in range(len(new)) if j != i and apart[i][j] <= (2 * radius) ** 2), key=lambda p: (p[1], p[0])))
    return Step(new, [a != b for a, b in zip(centroids, new, strict=True)], neighbours)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dimension: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row per vector of `dimension` finite components; others have none.

    Components count as floor(scale * x). The first centroids are the k
    vectors with the smallest sha256 of `seed:id` (then by id and components;
    fewer vectors, fewer centroids); each round assigns all vectors and moves every
    centroid that has members to the floor of their mean; at the end vectors are
    assigned once more. Rounds end early once no centroid moves, as nothing
    changes from there. Equal vectors and repeated rows are vectors of their
    own; a null id counts as the last; an empty table gives an empty one.
    Distances are squared and must fit a long; a scaled component of 2 ** 62 or more is an error.

    The driver holds k centroids and sums; vectors stay in their partitions,
    packed, and are written with their clusters every few rounds, from
    where later rounds go on if executors are lost.
    """
    spark = vectors.sparkSession
    prepare(spark)
    parts = F.col(vector_col).cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(parts.isNotNull() & (F.size(parts) == dimension)).filter(finite).select(F.col(id_col).alias("id"), parts.alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            none = pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(x, scale), pa.binary()), none, none.cast(pa.int64())], ["id", "v", "cluster", "distance"])

    now = kept.mapInArrow(pack, f"id {kept.schema['id'].dataType.simpleString()}, v binary, cluster int, distance long").checkpoint()
    first = now.withColumn("_place", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)).orderBy(F.col("_place").asc_nulls_last(), "v").limit(k).collect()
    centroids = [unpacked(pa.array([r["v"]], pa.binary()), dimension)[0].tolist() for r in first]
    steps = [Step(centroids, [True] * len(centroids), None)] if centroids else []
    for _ in range(rounds if centroids else 0):
        if len(steps) > ROUNDS_BETWEEN_WRITES:
            now, steps = assigned(now, steps, dimension).checkpoint(), []
        step = next_step(centroids, totals(now, steps, dimension))
        if not any(step.moved):
            break
        centroids = step.centroids
        steps.append(step)
    done = assigned(now, steps, dimension).select("id", "cluster", "distance").checkpoint()
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    ends = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(ends), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
