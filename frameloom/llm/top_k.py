"""Exact top-k by inner product with M-trees.

Inner products order vectors as distances do once every vector y gets one more
component, sqrt(M * M - |y|**2), where M is the largest norm: then the squared
distance to a query (with 0 there) is |q|**2 + M * M - 2 q.y.

The upper levels are the same for all: routing vectors from a bounded sample,
every vector with the nearest of them, and rings of its distance to it. A ring
is dealt into blocks, so no group of equal vectors meets in one task. Each
block builds an M-tree of its own: pages of entries, each entry with its
routing vector, covering radius and distance to its parent. A query first asks
one block of the ring that can be nearest to it, then, with the k-th score
found there, all blocks of the rings that the triangle inequality does not
put beyond it. Inside a block it takes pages best first, and an entry is passed
over without computing its distance when the stored distances already put all
of its subtree beyond the k-th best. Scores are computed in whole numbers.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .substring_dedup import packed

PAGE, FANOUT, BLOCK_ROWS = 64, 16, 8192
#: The sample from which routing vectors come; most of them, and most rings of each: what the driver holds does not grow with the table.
SAMPLE, ROUTES, RINGS = 2048, 256, 16
#: Groups without a routing vector: lengths that the sample does not hold, and vectors whose products with themselves need exact integers.
OTHER, LARGE = -1, -2
#: Scores beyond 64 bits count as the nearest score of 64 bits.
MOST = (1 << 63) - 1


class Page:
    """A leaf's vectors or a node's child pages; each with its distance to the page's own routing vector."""

    __slots__ = ("centre", "children", "radii", "rows", "to_parent", "vectors")


def build(points: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> Page:
    page = Page()
    page.centre, page.children, page.rows, page.radii = centre, None, rows, None
    own = points[rows]
    distance = np.sqrt(np.maximum(0.0, ((own - centre) ** 2).sum(1)))
    if len(rows) <= PAGE:
        order = np.argsort(distance, kind="stable")
        page.rows, page.vectors, page.to_parent = rows[order], own[order], distance[order]
        return page
    # Routing vectors: each the farthest from those before.
    chosen = [int(distance.argmax())]
    near = np.full(len(rows), np.inf)
    side = np.zeros(len(rows), np.int64)
    for k in range(FANOUT):
        d = ((own - own[chosen[k]]) ** 2).sum(1)
        side[d < near] = k
        near = np.minimum(near, d)
        chosen.append(int(near.argmax()))
        if near.max() <= 0:
            break
    if np.bincount(side).max() == len(rows):  # equal vectors: dealt out evenly
        side = np.arange(len(rows)) * FANOUT // len(rows)
        centres = {int(s): own[0] for s in np.unique(side)}
    else:
        centres = {int(s): own[chosen[s]] for s in np.unique(side)}
    page.children, vectors, radii = [], [], []
    for s, c in centres.items():
        mine = rows[side == s]
        page.children.append(build(points, mine, c))
        vectors.append(c)
        radii.append(math.sqrt(max(0.0, float(((points[mine] - c) ** 2).sum(1).max()))))
    page.vectors, page.radii = np.array(vectors), np.array(radii)
    page.to_parent = np.sqrt(((page.vectors - centre) ** 2).sum(1))
    return page


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray | list[int]:
    """Inner products of whole numbers (as float64), exactly."""
    if not len(vectors):
        return []
    most = float(np.abs(vectors).max()) * float(np.abs(query).max()) * len(query)
    if most < 2**53:
        return vectors @ query
    if most < 2**62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    whole = [int(x) for x in query.tolist()]
    return [max(-MOST, min(MOST, sum(int(x) * y for x, y in zip(v, whole, strict=True)))) for v in vectors.tolist()]


class Best:
    """The k best (score, id): high scores first, then small ids."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []  # a heap of (score, -id)

    def add(self, scores, ids: list[int], own: int) -> None:
        order = np.argsort(-scores, kind="stable").tolist() if isinstance(scores, np.ndarray) else range(len(scores))
        for r in order:
            score = int(scores[r])
            if len(self.heap) == self.k and isinstance(scores, np.ndarray) and score < self.heap[0][0]:
                return
            if ids[r] == own or self.k < 1:
                continue
            item = (score, -ids[r])
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, item)
            elif item > self.heap[0]:
                heapq.heapreplace(self.heap, item)

    def rows(self) -> list[tuple[int, int]]:
        return sorted(((s, -i) for s, i in self.heap), key=lambda x: (-x[0], x[1]))


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, large: bool = False) -> None:
        """vectors: whole numbers, as float64; `large` ones have no tree, each query reads them all."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.computed, self.root = 0, None
        if large or not len(ids):
            return
        norm = (self.vectors**2).sum(1)
        self.top = float(norm.max())
        self.points = np.concatenate([self.vectors, np.sqrt(np.maximum(0.0, self.top - norm))[:, None]], 1)
        self.slack = 1e-6 * (1 + math.sqrt(self.top))  # rounding never loses a vector
        self.root = build(self.points, np.arange(len(ids)), self.points.mean(0))

    def search(self, query: np.ndarray, k: int, own: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) other than id `own`: high scores first, then small ids; scores under `least` may lack."""
        best = Best(k)
        if self.root is None or float(np.abs(query).max()) >= math.sqrt(2.0**53 / len(query)):
            best.add(exact_scores(self.vectors, query), self.ids.tolist(), own)
            return best.rows()
        q = np.append(query, 0.0)
        square = float(query @ query) + self.top
        # No vector farther than this is wanted.
        bound = math.inf if least is None else math.sqrt(max(0.0, square - 2.0 * least))
        queue = [(0.0, 0, math.sqrt(((q - self.root.centre) ** 2).sum()), self.root)]
        serial = 1
        while queue:
            at_least, _, to_centre, page = heapq.heappop(queue)
            if at_least > bound + self.slack:
                break
            spread = np.abs(to_centre - page.to_parent)
            if page.children is None:
                # Vectors that the stored distances do not rule out.
                rows = page.rows[spread <= bound + self.slack]
                self.computed += len(rows)
                best.add(exact_scores(self.vectors[rows], query), self.ids[rows].tolist(), own)
                if len(best.heap) == k:
                    bound = min(bound, math.sqrt(max(0.0, square - 2.0 * best.heap[0][0])))
                continue
            open_ = np.flatnonzero(spread - page.radii <= bound + self.slack)
            self.computed += len(open_)
            distance = np.sqrt(((page.vectors[open_] - q) ** 2).sum(1))
            for j, d in zip(open_.tolist(), distance.tolist(), strict=True):
                nearest = max(0.0, d - float(page.radii[j]), at_least)
                if nearest <= bound + self.slack:
                    heapq.heappush(queue, (nearest, serial, d, page.children[j]))
                    serial += 1
        return best.rows()


ROW = "id long, dimension int, asks boolean, vector binary, large boolean, norm double"


def _whole(scale: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    y = np.clip(np.floor(scale * x), -1.7e308, 1.7e308) + 0.0
                    # Products of whole numbers below 2 ** 53 are exact in double precision.
                    large = float(np.abs(y).max()) >= math.sqrt(2.0**53 / len(y))
                    out.append((i, len(v), asks, y.tobytes(), large, 0.0 if large else float(y @ y)))
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [f.split()[0] for f in ROW.split(", ")])

    return work


class Routes:
    """Routing vectors, in the space with one more component, by dimension; a cell is the number of one."""

    def __init__(self, sample: list[tuple[int, bytes]], top: float, rows: int, block_rows: int) -> None:
        self.top, self.of, self.first, cells = top, {}, {}, 0
        want = min(ROUTES, max(1, math.ceil(rows / block_rows)))
        for d in sorted({d for d, _ in sample}):
            own = sorted({v for e, v in sample if e == d}, key=lambda v: zlib.crc32(v))
            own = own[: max(1, want * len(own) // len(sample))]
            if cells + len(own) > 2 * ROUTES:
                break  # lengths beyond these have no routing vectors
            self.of[d], self.first[d] = self.lifted(np.frombuffer(b"".join(own), np.float64).reshape(-1, d)), cells
            cells += len(own)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.top - (x * x).sum(1)))[:, None]], 1)

    def distances(self, x: np.ndarray, d: int) -> np.ndarray:
        """Of points in the space with one more component to the routing vectors of their dimension."""
        own = self.of[d]
        return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (own * own).sum(1) - 2.0 * (x @ own.T)))

    def cells(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the cell and the distance to its routing vector."""
        for batch in batches:
            dimension, vector, large = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("dimension", "vector", "large"))
            cell, distance = np.full(len(batch), OTHER, np.int32), np.zeros(len(batch))
            cell[np.array(large, bool)] = LARGE
            for d in set(dimension) & self.of.keys():
                k = np.array([j for j, (e, big) in enumerate(zip(dimension, large, strict=True)) if e == d and not big], np.int64)
                if len(k):
                    found = self.distances(self.lifted(np.frombuffer(b"".join(vector[j] for j in k), np.float64).reshape(-1, d)), d)
                    near = found.argmin(1)
                    cell[k], distance[k] = self.first[d] + near, found[np.arange(len(k)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], [*batch.schema.names, "cell", "distance"])


class Rings:
    """The rings of all cells: their least and greatest distances and the blocks into which each is dealt."""

    def __init__(self, routes: Routes, rings: list[tuple[int, int, float, float, int]]) -> None:
        self.routes, self.cell = routes, np.array([r[0] for r in rings], np.int64)
        self.ring, self.low, self.high, self.blocks = (np.array([r[k] for r in rings]) for k in (1, 2, 3, 4))

    def at_least(self, query: np.ndarray, large: bool) -> tuple[np.ndarray, float]:
        """No vector of a ring is nearer to the query than this (infinite: of another dimension), and what rounding may take away."""
        d, out = len(query), np.full(len(self.cell), math.inf)
        out[self.cell < 0] = 0.0
        if d in self.routes.of:
            first, n = self.routes.first[d], len(self.routes.of[d])
            own = (self.cell >= first) & (self.cell < first + n)
            if large:
                out[own] = 0.0
                return out, 0.0
            to = self.routes.distances(np.append(query, 0.0)[None], d)[0][self.cell[own] - first]
            out[own] = np.maximum(0.0, np.maximum(to - self.high[own], self.low[own] - to))
        return out, 1e-6 * (1 + math.sqrt(self.routes.top + (0.0 if large else float(query @ query))))

    def visits(self, again: bool):
        """The blocks that a query asks: at first one of the ring that can be nearest, then all of the rings that its k-th score does not rule out."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i, d, v, large, least in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    query = np.frombuffer(v, np.float64)
                    nearest, slack = self.at_least(query, large)
                    first = int(nearest.argmin())
                    if not again:
                        out.append((int(self.cell[first]), int(self.ring[first]), 0, i, d, v, None))
                        continue
                    bound = math.inf if least is None or large else math.sqrt(max(0.0, float(query @ query) + self.routes.top - 2.0 * least)) + slack
                    for r in np.flatnonzero((nearest <= bound) & (nearest < math.inf)).tolist():
                        for b in range(int(r == first), int(self.blocks[r])):
                            out.append((int(self.cell[r]), int(self.ring[r]), b, i, d, v, least))
                for lo in range(0, len(out), 8192):
                    yield packed(out[lo : lo + 8192], VISIT)

        return work


VISIT = "cell int, ring int, block int, id long, dimension int, vector binary, least long"
FOUND = "query_id long, vec_id long, score long"


def _answer(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, trees = None, {}, {}, {}
        for batch in batches:
            out = []
            for *b, kind, i, d, v, least in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if b != block:
                    block, ids, held, trees = b, {}, {}, {}
                if kind == 0:
                    ids.setdefault(d, []).append(i)
                    held.setdefault(d, []).append(v)
                    continue
                if d not in trees:
                    trees[d] = MTree(np.array(ids.get(d, []), np.int64), np.frombuffer(b"".join(held.get(d, [])), np.float64).reshape(-1, d), b[0] == LARGE)
                out += [(i, r, s) for s, r in trees[d].search(np.frombuffer(v, np.float64), k, i, least)]
            if out:
                yield packed(out, FOUND)

    return work


def top_k(vectors: DataFrame, asks: Column, k: int = 10, scale: float = 1024.0, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best of all other rows for each row of which `asks` is true.

    A vector's components are floor(scale * x), its score the inner product,
    exact for any finite vector; scores beyond 64 bits count as the nearest score
    of 64 bits. Ties go to the smaller id. Ids are whole numbers. Rows with a null id, and vectors that are null
    or empty or hold a null or a component that is not finite, take no part;
    vectors of other lengths are not candidates. Rows that share a query's id
    are its own; of several rows that ask under one id the one with the least
    length and bytes does. Rows that share another id are candidates each. An
    empty table gives an empty table.

    Vectors with components so large that their products need more than 53
    bits are kept apart, in blocks that every query reads in full.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.mapInArrow(_whole(scale), ROW).checkpoint()
    size = rows.agg(F.count("*").alias("n"), F.max("norm").alias("top")).first()
    sample = rows.filter("not large").select("dimension", "vector").orderBy(F.xxhash64("id", F.lit(3)), "id", "vector").limit(SAMPLE).collect()
    routes = Routes([(r["dimension"], bytes(r["vector"])) for r in sample], float(size["top"] or 0.0), size["n"], block_rows)
    kept = rows.mapInArrow(routes.cells, f"{ROW}, cell int, distance double").checkpoint()
    cuts = max(1, min(RINGS, math.ceil(size["n"] / block_rows / max(1, sum(map(len, routes.of.values()))))))
    steps = [n / cuts for n in range(1, cuts)]
    edges = {r["cell"]: r["e"] for r in kept.filter("cell >= 0").groupBy("cell").agg(F.percentile_approx("distance", steps, 1000).alias("e")).collect()} if steps else {}
    # At most 2 * ROUTES cells of RINGS rings; a row finds its own by place.
    ring = F.lit(0)
    if edges:
        bounds = F.array(*[F.lit([float(e) for e in edges.get(c) or [math.inf]]) for c in range(max(edges) + 1)])
        ring = F.size(F.filter(F.get(bounds, F.col("cell")), lambda x: x < F.col("distance")))
    kept = kept.withColumn("ring", F.when(F.col("cell") < 0, 0).otherwise(ring).cast("int")).checkpoint()
    found = kept.groupBy("cell", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).orderBy("cell", "ring").collect()
    if not found:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    rings = Rings(routes, [(r["cell"], r["ring"], r["low"], r["high"], math.ceil(r["n"] / block_rows)) for r in found])
    blocks = max(1, int(rings.blocks.sum()))
    dealt_to = np.ones((int(rings.cell.max()) - LARGE + 1) * RINGS, np.int64)
    dealt_to[(rings.cell - LARGE) * RINGS + rings.ring] = rings.blocks
    among = F.get(F.lit(dealt_to), (F.col("cell") - LARGE) * RINGS + F.col("ring"))
    here = kept.select("cell", "ring", F.pmod(F.xxhash64("id", F.lit(9)), among).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "dimension", "vector", F.lit(None).cast("long").alias("least"))
    asking = kept.filter("asks").groupBy("id").agg(F.min(F.struct("dimension", "vector", "large")).alias("q")).select("id", "q.*").checkpoint()

    def answered(visits: DataFrame, vectors: DataFrame) -> DataFrame:
        dealt = vectors.unionByName(visits.withColumn("kind", F.lit(1)))
        # More partitions than blocks, so that few of them share one.
        return dealt.repartition(4 * blocks, "cell", "ring", "block").sortWithinPartitions("cell", "ring", "block", "kind").mapInArrow(_answer(k), FOUND)

    # At first only one block of each ring is asked, so no other travels.
    first = answered(asking.select("id", "dimension", "vector", "large", F.lit(None).cast("long").alias("least")).mapInArrow(rings.visits(False), VISIT), here.filter("block = 0")).checkpoint()
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("s")).alias("least"))
    second = asking.join(known, "id", "left").select("id", "dimension", "vector", "large", "least").mapInArrow(rings.visits(True), VISIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = first.unionByName(answered(second, here))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
