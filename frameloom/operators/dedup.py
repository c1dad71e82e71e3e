"""One detection for each (frame, animal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["ANIMALID", "FRAMENUMBER"]


def _identified() -> Column:
    return F.col("FRAMENUMBER").isNotNull() & F.col("ANIMALID").isNotNull()


def groups(raw: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """A row per key: n, agree (all data equal, nulls and NaNs too) and first, the row with the least _rowid.

    Partial aggregates meet in one shuffle, so no key is sorted or held.
    """
    data = [c for c in raw.columns if c not in (*KEY, "_rowid", *ignore)]
    values = F.struct(*[F.col(c) for c in data]) if data else F.struct(F.lit(0))
    whole = F.struct("_rowid", *[c for c in raw.columns if c not in (*KEY, "_rowid")])
    return raw.filter(_identified()).groupBy(*KEY).agg(F.count("*").alias("n"), F.min(values).eqNullSafe(F.max(values)).alias("agree"), F.min_by(whole, "_rowid").alias("first"))


def dedup(raw: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Equal rows of a key keep the one with the least _rowid; a key whose rows disagree goes; rows without a key stay.

    `ignore` names surrogate keys, which are not compared.
    """
    kept = groups(raw, ignore).filter("agree").select(*KEY, "first.*").select(*raw.columns)
    return kept.unionByName(raw.filter(~_identified()))


def stats(raw: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row: groups and rows of either case, rows without a key, rows before and after."""
    g = groups(raw, ignore).agg(
        F.coalesce(F.sum(F.when((F.col("n") > 1) & F.col("agree"), 1)), F.lit(0)).alias("case_a_groups"),
        F.coalesce(F.sum(F.when((F.col("n") > 1) & F.col("agree"), F.col("n"))), F.lit(0)).alias("case_a_rows"),
        F.coalesce(F.sum(F.when(~F.col("agree"), 1)), F.lit(0)).alias("case_b_groups"),
        F.coalesce(F.sum(F.when(~F.col("agree"), F.col("n"))), F.lit(0)).alias("case_b_rows"),
        F.coalesce(F.sum(F.when(F.col("agree"), 1)), F.lit(0)).alias("_kept"),
    )
    all_ = raw.agg(F.count("*").alias("rows_before"), F.count_if(~_identified()).alias("missing_identity"))
    return all_.join(g, how="cross").select("rows_before", "missing_identity", "case_a_groups", "case_a_rows", "case_b_groups", "case_b_rows", (F.col("_kept") + F.col("missing_identity")).alias("rows_after"))


def conflicts(raw: DataFrame, limit: int = 10, ignore: tuple[str, ...] = ()) -> DataFrame:
    """The first keys (by row) whose rows disagree."""
    return groups(raw, ignore).filter(~F.col("agree")).select(*KEY, "n", F.col("first._rowid").alias("first_rowid")).orderBy("first_rowid").limit(limit)
