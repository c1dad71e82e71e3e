"""Language identification by the nearest of several TF-IDF centroids per language.

A text is a vector of hashed letter trigrams (over lower-cased UTF-8, anything
but letters read as a space), weighted (1 + ln tf) * idf and normalised. Idf
comes from every row that may be learned from; centroids are found by spherical
k-means in a sample of at most FIT_ROWS of these rows, dealt evenly to the
languages. A text gets the language of the centroid with the highest cosine;
it is rejected (a flag of its own) if it is further from that centroid than
all but a REJECT share of the language's sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, passes, prepare

DIMENSIONS, FIT_ROWS, CLUSTERS, REJECT = 8192, 4000, 4, 0.005
_letter = np.full(256, 32, np.uint8)
_letter[97:123] = np.arange(97, 123)
_letter[128:] = np.arange(128, 256)
_likely_letter = re.compile(r"[^\W\d_]").search


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; number forms such as a half or a Roman numeral are none."""
    first = _likely_letter(text) if text else None
    return first is not None and (first[0].isalpha() or any(map(str.isalpha, text)))



def grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each text and its trigrams' dimensions."""
    lowered = pa.array([(t or "").lower().encode() for t in texts.to_pylist()], pa.large_binary())
    data, offsets = binary(lowered)
    for lo, hi in passes(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        b = _letter[data[offsets[lo] : offsets[hi]]].astype(np.uint32)
        key = np.zeros(0, np.uint32)
        if len(b) >= 3:
            key = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(19)
            key[(b[:-2] == 32) & (b[1:-1] == 32) | (b[1:-1] == 32) & (b[2:] == 32)] = DIMENSIONS  # runs of spaces say nothing
        for k in range(lo, hi):
            own = key[at[k - lo] : max(at[k - lo], at[k - lo + 1] - 2)]
            yield k, own[own < DIMENSIONS]


def weighted(own: np.ndarray, idf: np.ndarray) -> np.ndarray:
    tf = np.bincount(own, minlength=DIMENSIONS).astype(np.float32)
    hit = tf > 0
    tf[hit] = (1 + np.log(tf[hit])) * idf[hit]
    norm = float(np.sqrt(tf @ tf))
    return tf / norm if norm else tf


def _document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of each dimension, over all rows, and the number of rows; summed on the executors in 64 groups."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for _, own in grams(batch.column(0)):
                df[:DIMENSIONS] += np.bincount(own, minlength=DIMENSIONS) > 0
                df[DIMENSIONS] += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()])], ["df"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"df": [sum(np.frombuffer(x, np.int64) for x in group["df"].to_pylist()).tobytes()]})

    parts = rows.select("text").mapInArrow(count, "df binary").withColumn("g", F.spark_partition_id() % 64)
    got = [np.frombuffer(r["df"], np.int64) for r in parts.groupBy("g").applyInArrow(lambda t: add(t), "df binary").collect()]
    total = sum(got) if got else np.zeros(DIMENSIONS + 1, np.int64)
    return total[:DIMENSIONS], int(total[DIMENSIONS])


def _clusters(vectors: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means from farthest-first starts."""
    centres = [vectors.mean(0)]
    while len(centres) < min(k, len(vectors)):
        near = np.max(vectors @ np.array(centres).T / np.maximum(np.linalg.norm(centres, axis=1), 1e-9), axis=1)
        centres.append(vectors[int(np.argsort(near, kind="stable")[len(near) // 20])])  # far, but no outlier
    c = np.array(centres)
    for _ in range(12):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (vectors @ c.T).argmax(1)
        c = np.array([vectors[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


class Centroids:
    """Languages by name, where each one's centroids start, unit centroids, idf, and the distance beyond which a text is rejected."""

    def __init__(self, names: list[str], starts: list[int], centroids: np.ndarray, idf: np.ndarray, reach: np.ndarray) -> None:
        self.names, self.starts, self.centroids, self.idf, self.reach = names, starts, centroids, idf, reach

    def nearest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's language and the cosine to its nearest centroid."""
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        matrix, first = np.zeros((128, DIMENSIONS), np.float32), 0
        for k, own in grams(texts):
            matrix[k - first] = weighted(own, self.idf)
            if k - first == 127 or k == len(texts) - 1:
                cosine = np.maximum.reduceat(matrix[: k + 1 - first] @ self.centroids.T, self.starts, axis=1)
                best[first : k + 1] = cosine.argmax(1)
                score[first : k + 1] = np.clip(cosine.max(1), 0, 1)
                first = k + 1
        return best, score


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS) -> Centroids | None:
    """Idf from every row that may be learned from, centroids from a sample of about fit_rows of them; None without such rows.

    Rows are drawn by their place, not by their id, and languages get equal
    shares, so what comes to the driver is bounded by fit_rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(learn, F.lit(False)).alias("learn"), F.monotonically_increasing_id().alias("row"))
    known = rows.filter("learn and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    df, n = _document_frequency(known)
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    names, starts = sorted(counts), []
    part = F.create_map(*[F.lit(x) for lang in names for x in (lang, min(1.0, fit_rows / len(names) / counts[lang]))])
    drawn = F.pmod(F.xxhash64(F.col("row"), F.lit(11)), F.lit(1_000_003)) / 1_000_003.0 < part[F.col("lang")]

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, own in grams(batch.column(1)):
                v = weighted(own, idf)
                at = np.flatnonzero(v)
                out.append((at.astype(np.uint16).tobytes(), v[at].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.binary()), pa.array([v for _, v in out], pa.binary())], ["lang", "at", "v"])

    sample = known.filter(drawn).select("lang", "text").mapInArrow(sparse, "lang string, at binary, v binary").collect()
    blocks, far = [], []
    for lang in names:
        own = [r for r in sample if r["lang"] == lang and len(r["at"])]
        own.sort(key=lambda r: (bytes(r["at"]), bytes(r["v"])))
        vectors = np.zeros((len(own), DIMENSIONS), np.float32)
        for k, r in enumerate(own):
            vectors[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["v"], np.float32)
        starts.append(sum(map(len, blocks)))
        blocks.append(_clusters(vectors, clusters) if len(own) else np.zeros((1, DIMENSIONS)))
        near = (vectors @ blocks[-1].T).max(1) if len(own) else np.zeros(1)
        far.append(1 - np.quantile(near, REJECT))
    return Centroids(names, starts, np.concatenate(blocks).astype(np.float32), idf, np.array(far))


def language(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS, und: str = "und") -> DataFrame:
    """id, lang_pred, score and rejected of every row; `learn` is true of rows whose text and language may be learned from.

    score is the cosine to the nearest centroid. A text that is null or has no
    letter is `und` with score 0; so is every text if nothing can be learned
    from. Texts of under three bytes have no trigram and get the first
    language with score 0. Ties go to the language first by name. A null id
    stays null; repeated rows count each. An empty table gives an empty table.
    """
    model = fit(docs, learn, text_col, lang_col, fit_rows, clusters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            has = [model is not None and has_letter(t) for t in texts.to_pylist()]
            best, score = model.nearest(texts) if model else (np.zeros(len(texts), np.int64), np.zeros(len(texts)))
            found = [model.names[b] if h else und for b, h in zip(best.tolist(), has, strict=True)]
            score = np.where(has, score, 0.0)
            away = [bool(h and 1 - s > model.reach[b]) for b, h, s in zip(best.tolist(), has, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(away, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
