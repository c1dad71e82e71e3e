"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .ball_kmeans import cluster
from .common import table
from .exact_dedup import exact_dedup
from .language import language
from .mixing import mix
from .mixing import oracle as mix_oracle
from .ngram_join import ngram_components
from .packing import pack
from .spelling import spelling_variants
from .substring_dedup import remove_repeats
from .suffix_dedup import remove_repeated_bytes
from .token_counts import token_counts
from .top_k import top_k
from .toxicity import toxicity
from .vector_dedup import vector_groups

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold(3) != 1)
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_clauses")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 100 == 0, k=10)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language(table(spark, sf_dir, "documents"), learn=fold(4) != 2)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_length=7, least_count=2, ratio=10, noise=31)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dimension=64, seed=3)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_jaccard, op2_substring_dedup, op3_embedding_dedup, op4_toxicity, op5_source_mix, op6_token_counts, op7_best_fit_packing, op8_suffix_dedup, op9_exact_top_k, op10_language, op11_spelling_variants, op12_exact_dedup, op13_centroid_clusters)}
#: Of the operators that SQL can express; op4, op6, op7 and op10 have plain versions in the tests.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.ngram_join(4, 85),
    "op2_substring_dedup": oracles.substring_dedup(35),
    "op3_embedding_dedup": oracles.vector_dedup(0.9),
    "op5_source_mix": mix_oracle(),
    "op8_suffix_dedup": oracles.suffix_dedup(100),
    "op9_exact_top_k": oracles.top_k(100, 10, 1024),
    "op11_spelling_variants": oracles.spelling_variants(7, 2, 10, 31),
    "op12_exact_dedup": oracles.exact_dedup(),
    "op13_centroid_clusters": oracles.centroid_clusters(8, 10, 1024, 64, 3),
}
