"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Three times over, a vector's signs are flipped at random and it is multiplied by
the Hadamard matrix, which takes d log d additions; its hash is the axis, with
sign, that it lies nearest to. A table's key has as many such hashes as leave a
few vectors to a bucket, and a vector also visits the buckets of its next best
keys (multiprobe). First only numbers of rows and buckets travel: buckets that
nobody lives in, or that hold one vector, are left out, and large ones are cut
into parts. Then sketches meet there, BITS signs of a vector's products with random directions; a pair at the
threshold differs in no more of them than `unlike` says, but for MISSED of all such pairs. Only vectors that
some other one in a bucket is that near to go to it whole, where residents meet each other and the visitors;
cosines are computed in double precision, and a pair found in several tables
counts in the first one only, which the keys of both tell; these are computed again, for vectors that are alike only. Longer keys make a
meeting in one table rarer, so there are as many tables as keep recall at RECALL. A bucket returns
how many vectors each of its members is linked to and links that join its
components, never all pairs. Equal vectors are collapsed before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, prepare
from .components import components, looked_up
from .substring_dedup import packed

#: The fewest tables; the most before keys get narrower instead.
TABLES, MOST_TABLES, PROBES, SEED = 8, 64, 4, 20240607
#: The chance that a pair at the threshold itself is found, whatever the table's size; pairs tried to tell how many tables that takes.
RECALL, TRIALS = 0.998, 1000
#: Vectors that a bucket should hold, and that one block of a large bucket does.
BUCKET_ROWS, BLOCK_ROWS = 32, 1024
#: Signs in a sketch, and the chance that a pair at the threshold differs in more of them than is allowed.
BITS, MISSED = 128, 1e-6
VISITS = "rid long, bucket long, resident boolean, sketch binary"
MET = "rid long, bucket long, pair int, resident boolean, part int, parts int"
LINKS = "rid long, other long, n long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


class Hashes:
    """Keys of unit vectors of one length."""

    def __init__(self, dimension: int, tables: int, width: int, probes: int) -> None:
        self.size = max(2, 1 << (dimension - 1).bit_length())
        self.tables, self.width, self.probes = tables, width, probes
        self.signs = np.random.default_rng([SEED, dimension]).choice([-1.0, 1.0], (tables, width, 3, self.size))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """[row, table, 1 + probes]: a row's own key and its next best ones; without hashes, all rows have one key."""
        if not self.width:
            return np.repeat(np.arange(self.tables), 1 + self.probes).reshape(1, self.tables, -1).repeat(len(x), 0)
        padded = np.zeros((len(x), self.size))
        padded[:, : x.shape[1]] = x
        out = np.empty((len(x), self.tables, 1 + self.probes), np.int64)
        near = min(self.probes, 2 * self.size - 1)  # no more than there are other axes
        for t in range(self.tables):
            best, loss = [], []
            for w in range(self.width):
                y = padded
                for r in range(3):
                    y = hadamard(y * self.signs[t, w, r])
                both = np.concatenate([y, -y], 1)
                top = np.sort(np.argpartition(-both, near, axis=1)[:, : 1 + near], axis=1)
                value = np.take_along_axis(both, top, 1)
                order = np.argsort(-value, axis=1, kind="stable")
                top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
                best.append(top)
                loss.append((value[:, :1] - value) ** 2)  # how much worse than the nearest axis
            # Keys by the least total loss, of those that change one hash or, for the first two choices, two.
            options = [(0,) * self.width]
            options += [tuple(p if v == w else 0 for v in range(self.width)) for w in range(self.width) for p in range(1, 1 + near)]
            options += [tuple(1 if v in (a, b) else 0 for v in range(self.width)) for a in range(self.width) for b in range(a)]
            cost = np.stack([sum(loss[w][:, o] for w, o in enumerate(option)) for option in options], 1)
            cost[:, 0] = -1.0
            code = np.stack([sum(best[w][:, o] * (2 * self.size) ** w for w, o in enumerate(option)) for option in options], 1)
            chosen = np.argsort(cost, axis=1, kind="stable")[:, : 1 + self.probes]
            keys = np.take_along_axis(code, chosen, 1)
            if keys.shape[1] <= self.probes:
                keys = np.concatenate([keys, np.repeat(keys[:, :1], 1 + self.probes - keys.shape[1], 1)], 1)
            out[:, t] = keys * self.tables + t
        return out


def width_for(rows: int, dimension: int) -> int:
    """Hashes in a key, such that about BUCKET_ROWS vectors fall to one of the (2 d) ** width buckets if they are spread evenly."""
    size = max(2, 1 << (dimension - 1).bit_length())
    return max(1, round(math.log(max(1, rows) / BUCKET_ROWS) / math.log(2 * size)))


def tables_for(dimension: int, width: int, probes: int, least: float) -> int:
    """Tables in one of which a pair whose cosine is `least` meets with a probability of RECALL.

    Rotations are random, so all such pairs have the same chance in a table;
    random ones tell it, less two standard errors.
    """
    if not width:
        return 1
    if dimension < 2:
        return TABLES
    rng = np.random.default_rng([SEED, dimension, width])
    a, b = rng.normal(size=(2, TRIALS, dimension))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = min(1.0, max(-1.0, least))
    hashes = Hashes(dimension, TABLES, width, probes)
    x, y = hashes.keys(a), hashes.keys(cosine * a + math.sqrt(1 - cosine * cosine) * b)
    share = float(((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean())
    share -= 2 * math.sqrt(share * (1 - share) / (TRIALS * TABLES))
    share = min(max(share, 0.5 / (TRIALS * TABLES)), 1 - 1e-9)
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - share)))


def keys_for(rows: int, dimension: int, least: float, probes: int) -> tuple[int, int]:
    """Tables and width: a width that would take more than MOST_TABLES is cut, and buckets are larger instead (without hashes, one exact bucket)."""
    width = width_for(rows, dimension)
    while (tables := tables_for(dimension, width, probes, least)) > MOST_TABLES:
        width -= 1
    return tables, width


def directions(dimension: int) -> np.ndarray:
    """The directions of sketches, one a column."""
    return np.random.default_rng([SEED, dimension, BITS]).normal(size=(dimension, BITS))


def unlike(least: float) -> int:
    """The fewest signs that may differ so that a pair whose cosine is `least` passes but for MISSED: each differs with a chance of angle / pi."""
    p = math.acos(min(1.0, max(-1.0, least))) / math.pi
    rest, k = 1.0, -1
    while k < BITS and rest > MISSED:
        k += 1
        rest -= math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
    return k


def signs(sketches: list[bytes]) -> np.ndarray:
    """1 or -1 for each bit, so that a product of two rows is BITS less twice the signs that differ."""
    bits = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BITS // 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def units(vectors: list[bytes], dimension: int) -> np.ndarray:
    """Unit vectors, in double precision, of vectors given as bytes of either precision."""
    kinds = {4 * dimension: np.float32, 8 * dimension: np.float64}
    if len({len(v) for v in vectors}) > 1:
        vectors = [np.frombuffer(v, kinds[len(v)]).astype(np.float64).tobytes() for v in vectors]
    x = np.frombuffer(b"".join(vectors), kinds[len(vectors[0])]).reshape(len(vectors), dimension).astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def alike(m: Members, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of members of one block whose rows have a product of `least` or more and of which one lives there."""
    pair, sides = int(m.block[0, 1]), int(m.parts[0])
    across = pair >= 0 and pair // sides != pair % sides  # pairs within a part are counted in that part's own block
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not m.resident.any():
        return out_i[0], out_j[0]
    for lo in range(0, len(m), 256):
        i, j = np.nonzero(m.x[lo : lo + 256] @ m.x.T >= least)
        i = i + lo
        if len(i) <= min(256, len(m) - lo):  # each row with itself
            continue
        keep = (i < j) & (m.resident[i] | m.resident[j])
        if across:
            keep &= m.part[i] != m.part[j]
        out_i.append(i[keep])
        out_j.append(j[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def fresh(m: Members, i: np.ndarray, j: np.ndarray, hashes: Hashes) -> np.ndarray:
    """Which of these pairs, of any blocks, do not meet in an earlier table, nor in this one where the lesser of them lives."""
    out = np.ones(len(i), bool)
    if not len(i):
        return out
    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    # A row is a member of many blocks, but its keys are the same in each.
    rid, first, same = np.unique(m.rid[some], return_index=True, return_inverse=True)
    keys = np.concatenate([hashes.keys(m.x[some[first[lo : lo + 512]]]) for lo in range(0, len(rid), 512)])
    at = same[at]
    for lo in range(0, len(i), 16_384):
        p, q = i[lo : lo + 16_384], j[lo : lo + 16_384]
        a, b = keys[at[: len(i)][lo : lo + 16_384]], keys[at[len(i) :][lo : lo + 16_384]]
        table, row = m.block[p, 0] % hashes.tables, np.arange(len(p))
        ok = np.ones(len(p), bool)
        for t in range(int(table.max())):
            ok &= (table <= t) | ~((a[:, t, :1] == b[:, t]).any(1) | (b[:, t, :1] == a[:, t]).any(1))
        a, b = a[row, table], b[row, table]
        home_is_a = m.resident[p]
        home, guest = np.where(home_is_a[:, None], a, b), np.where(home_is_a[:, None], b, a)
        both_ways = (guest[:, :1] == home[:, 1:]).any(1)
        lesser = np.where(home_is_a, m.rid[q] < m.rid[p], m.rid[p] < m.rid[q])
        out[lo : lo + 16_384] = ok & ~(~(m.resident[p] & m.resident[q]) & both_ways & lesser)
    return out


class Members:
    """Rows of one or more blocks, as arrays: their vectors, or the signs of their sketches."""

    def __init__(self, batch: pa.RecordBatch, x: np.ndarray) -> None:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        self.block = np.stack([column("bucket").to_numpy(), column("pair").to_numpy().astype(np.int64)], 1)
        self.resident = column("resident").to_numpy(zero_copy_only=False)
        self.rid, self.n = column("rid").to_numpy(), column("n").to_numpy()
        self.part, self.parts = (column(c).fill_null(-1).to_numpy() for c in ("part", "parts"))
        self.x = x

    def spans(self) -> list[tuple[int, int]]:
        """First and last row of each block, the last one not included."""
        first = np.flatnonzero(np.concatenate([[True], (self.block[1:] != self.block[:-1]).any(1)])) if len(self) else np.zeros(0, np.int64)
        return list(zip(first.tolist(), [*first[1:].tolist(), len(self)], strict=True)) if len(first) else []

    def __getitem__(self, rows: slice) -> Members:
        out = object.__new__(Members)
        out.__dict__ = {k: v[rows] for k, v in self.__dict__.items()}
        return out

    def __add__(self, other: Members) -> Members:
        out = object.__new__(Members)
        out.__dict__ = {k: np.concatenate([v, getattr(other, k)]) for k, v in self.__dict__.items()}
        return out

    def __len__(self) -> int:
        return len(self.rid)


def block_by_block(batches: Iterator[pa.RecordBatch], name: str, rows, solve, schema: str) -> Iterator[pa.RecordBatch]:
    """What `solve` makes of whole blocks; batches are sorted by block, and `rows` makes an array of the column of that name."""
    held = None  # the rows of the last block so far
    for batch in batches:
        for lo in range(0, len(batch), 2048):
            part = batch.slice(lo, 2048)
            now = Members(part, rows(part.column(part.schema.get_field_index(name)).to_pylist()))
            now = now if held is None else held + now
            last = now.spans()[-1][0]
            if out := solve(now[:last]):
                yield packed(out, schema)
            held = now[last:]
    if held is not None and (out := solve(held)):
        yield packed(out, schema)


def near(m: Members, least: float) -> list[tuple]:
    """Of whole blocks: the members whose sketch is near that of another one there."""
    met = np.zeros(len(m), bool)
    for lo, hi in m.spans():
        if hi - lo > 1:
            i, j = alike(m[lo:hi], least)
            met[lo + i] = met[lo + j] = True
    k = np.flatnonzero(met)
    columns = (m.rid[k], m.block[k, 0], m.block[k, 1], m.resident[k], m.part[k], m.parts[k])
    return list(zip(*(c.tolist() for c in columns), strict=True))


def solve(m: Members, hashes: Hashes, least: float) -> list[tuple]:
    """Of whole blocks: (rid, other, n): n vectors more that rid is linked to (other null), or a link that joins components."""
    if len(m) < 2:
        return []
    found = [(lo, *alike(m[lo:hi], least)) for lo, hi in m.spans() if hi - lo > 1]
    i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] + f[0] for f in found)]) for k in (1, 2))
    keep = fresh(m, i, j, hashes)
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    more = np.bincount(i, m.n[j], len(m)) + np.bincount(j, m.n[i], len(m))
    out = [(int(m.rid[k]), None, int(more[k])) for k in np.flatnonzero(more)]
    parent = list(range(len(m)))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(m.rid[a]), int(m.rid[b]), None))
    return out


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """rid, id, dimension, vector (bytes of either precision; null if null, empty, zero or not finite throughout)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                ok = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and x.any():
                        x = x + 0.0  # -0.0 is 0.0
                        # Half as many bytes where single precision holds the same values, so equal vectors have equal bytes.
                        with np.errstate(over="ignore"):
                            single = x.astype(np.float32)
                        ok = (single if (single == x).all() else x).tobytes()
                out.append((0 if ok is None else len(v), ok))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d for d, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], ["rid", "id", "dimension", "vector"])

    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(work, "rid long, id long, dimension int, vector binary")


def vector_groups(vectors: DataFrame, least: float = 0.9, tables: int | None = None, probes: int = PROBES, width: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of every row.

    Rows link if the cosine of their vectors, in double precision, is `least`
    or more. Vectors that are null, empty or zero, or hold a null or a
    component that is not finite, link with nothing, nor do vectors of unlike
    lengths. Repeated rows and equal vectors link with each other. A
    component's id is its least id; ids are whole numbers, and a null one stays null and is kept. An empty
    table gives an empty table. A link is found with a probability of RECALL or
    more, whatever the table's size, unless `tables` says otherwise; none is wrong.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = valid_vectors(vectors, id_col, vector_col).checkpoint()
    classes = rows.filter("vector is not null").groupBy("dimension", "vector").agg(F.min("rid").alias("rid"), F.count("*").alias("n")).checkpoint()
    sizes = {r["dimension"]: r["m"] for r in classes.groupBy("dimension").agg(F.count("*").alias("m")).collect()}
    parts = parts_for(rows)
    found = spark.createDataFrame([], LINKS)
    for dimension, m in sorted(sizes.items()):
        most, wide = keys_for(m, dimension, least, probes) if width is None else (tables_for(dimension, width, probes, least), width)
        found = found.unionByName(_one_length(classes.filter(F.col("dimension") == dimension), dimension, least, tables or most, probes, wide, parts))
    found = found.checkpoint()
    more = found.filter("other is null").groupBy("rid").agg(F.sum("n").alias("more"))
    joined = components(found.filter("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "rid", "component": "root"})
    told = classes.join(more, "rid", "left").join(joined, "rid", "left").select("dimension", "vector", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rid").alias("root"))
    # A vector that very many rows share, or a component of very many, is joined where its rows are.
    alike = looked_up(rows.filter("vector is not null"), told.checkpoint(), ["dimension", "vector"]).select("id", "n_links", "root")
    full = alike.unionByName(rows.filter("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("rid").alias("root"))).checkpoint()
    first = full.groupBy("root").agg(F.min("id").alias("component_id")).checkpoint()
    out = looked_up(full, first, ["root"]).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")) | F.col(id_col).isNull())


def _one_length(classes: DataFrame, dimension: int, least: float, tables: int, probes: int, width: int, parts: int) -> DataFrame:
    hashes, towards = Hashes(dimension, tables, width, probes), directions(dimension)
    most = unlike(least) if width else BITS  # without hashes, nothing may be missed

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                own = batch.slice(lo, 512)
                x = units(own.column(1).to_pylist(), dimension)
                keys = hashes.keys(x)
                row = np.repeat(np.arange(len(own)), keys.shape[1] * keys.shape[2])
                home = np.tile(np.arange(keys.shape[1] * keys.shape[2]) % (1 + probes) == 0, len(own))
                flat = keys.ravel()
                _, first = np.unique(np.stack([row, flat], 1), axis=0, return_index=True)
                first.sort()
                at = pa.array(row[first])
                bits = np.packbits(x @ towards >= 0, axis=1)
                sketch = pa.array([b.tobytes() for b in bits], pa.binary()).take(at)
                yield pa.RecordBatch.from_arrays([own.column(0).take(at), pa.array(flat[first]), pa.array(home[first]), sketch], ["rid", "bucket", "resident", "sketch"])

    source = classes.select("rid", "n", "vector").checkpoint()
    visits = source.select("rid", "vector").mapInArrow(keyed, VISITS).checkpoint()
    used = visits.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("resident").alias("live")).filter("size > 1 and live > 0")
    # Large buckets are cut into parts, and every pair of parts is a block of its own.
    used = used.select("bucket", F.when(F.col("size") > BLOCK_ROWS, F.ceil(F.col("size") / F.lit(BLOCK_ROWS)).cast("int")).alias("parts")).checkpoint()
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, F.col("part")) * F.col("parts") + F.greatest(k, F.col("part"))))
    asked = looked_up(visits, used, ["bucket"]).withColumn("part", part)
    asked = asked.select("bucket", "resident", "rid", F.lit(1).cast("long").alias("n"), "sketch", "part", "parts", F.explode(pairs).alias("pair"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_by_block(batches, "sketch", signs, lambda m: near(m, BITS - 2 * most), MET)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_by_block(batches, "vector", lambda v: units(v, dimension), lambda m: solve(m, hashes, least), LINKS)

    met = asked.repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(sketched, MET)
    met = met.groupBy("rid").agg(F.collect_list(F.struct("bucket", "pair", "resident", "part", "parts")).alias("b"))
    members = source.join(met, "rid").select("rid", "n", "vector", F.inline("b"))
    return members.repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(whole, LINKS)
