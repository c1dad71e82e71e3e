"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document, in the shuffled order of its source, gets a virtual finish
time: the words of its source up to its own end, divided by the source's
target. Documents served in the order of these times give every source its
share at any moment, so the mix is the range-sorted order cut at the total
budget. A source whose target is above its size is queued again from its
start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Words as this package counts them.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, repeats: int) -> DataFrame:
    """source, source_size, target: a row per source of a table (source, source_size).

    Sources by code point, null last, have the weights in turn and share
    percent/100 of all sizes; a target stops at `repeats` times its source's
    size and the excess goes to the others by weight. Filling up to a common
    level L, min(cap, weight * L), has for each number k of stopped sources
    (those with the least cap / weight) the candidate (total - their caps) /
    (other weights); the level is the largest candidate.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    chosen = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.select("source", "source_size", chosen.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    stopped = named.filter("cap > 0").select("source", F.sum("source_size").over(every).alias("total"), F.sum("weight").over(every).alias("weights"), F.coalesce(F.sum("cap").over(order), F.lit(0)).alias("caps"), F.coalesce(F.sum("weight").over(order), F.lit(0)).alias("used"))
    level = stopped.agg(F.max((F.col("total") * percent / 100.0 - F.col("caps")) / (F.col("weights") - F.col("used"))).alias("level")).first()["level"]
    return named.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level or 0.0))).alias("target"))


#: Rows that one range of a source's order should hold.
SLOT_ROWS = 50_000


def shuffled(seed: int, id_: Column, text: Column) -> Column:
    """The place of a document in the shuffled order of its source; rows without an id, or that share one, differ by their texts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, repeats: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, size, source_size, target and taken (words the mix takes of a document, repeats counted), and the columns of `keep`.

    A null text has size 0 and is never taken; a null source is a source of
    its own, the last; repeated rows are documents of their own. Ties in the
    shuffled order go by size and ties in finish time by that order, so reruns
    agree. Prefix sums over a source and over the whole queue are built from
    sums of ranges (of the hash, of the finish time), so neither a source nor
    the queue is ever sorted in one task.
    """
    spark = docs.sparkSession
    prepare(spark)
    bins = 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = {c: f"_{k}" for k, c in enumerate(keep)}
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"), shuffled(seed, F.col(id_col), F.col(text_col)).alias("place"), *[F.col(c).alias(k) for c, k in mine.items()])
    rows = rows.checkpoint()
    # Ranges of each source's order: as many hexadecimal digits of the place as leave SLOT_ROWS in one if a source has all rows, and three at least.
    digits = max(3, math.ceil(math.log(max(1, rows.count()) / SLOT_ROWS, 16)))
    rows = rows.withColumn("slot", F.substring("place", 1, digits))
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("source").alias("s2"), F.col("slot").alias("p2"), F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("ahead"))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, repeats).withColumnRenamed("source", "s3").checkpoint()
    # Frames of rows: equal documents have each a place of their own.
    within = Window.partitionBy("source", "slot").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.withColumn("so_far", F.sum("size").over(within))
    queue = queue.join(slots, F.col("source").eqNullSafe(F.col("s2")) & (F.col("slot") == F.col("p2"))).join(wanted, F.col("source").eqNullSafe(F.col("s3")))
    # Only documents with words stand in the queue; the n-th time round, a source's documents end n * source_size later.
    finish = F.when((F.col("size") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda n: (n * F.col("source_size") + F.col("ahead") + F.col("so_far")) / F.col("target")))
    queue = queue.select("_id", "source", "size", "place", "source_size", "target", finish.alias("finish"), *mine.values()).checkpoint()
    # A source reaches its target at time 1, so the cut is near 1: times from 0 to 2 are dealt into equal ranges.
    times = queue.select("source", "size", "place", F.explode("finish").alias("time")).withColumn("range", F.least(F.floor(F.col("time") * (bins / 2)), F.lit(bins)))
    served = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    totals = times.groupBy("range").agg(F.sum("size").alias("n")).select("range", "n", F.sum("n").over(served).alias("upto"))
    budget = float(wanted.agg(F.sum("target").alias("b")).first()["b"] or 0.0)
    # The range in which the budget ends, and the last time in it that the budget still covers.
    cut = totals.filter(F.col("upto") > F.lit(budget)).orderBy("range").select("range", (F.col("upto") - F.col("n")).alias("served")).first()
    until = float("inf")
    if cut is not None:
        order = Window.orderBy("time", "place", "source", "size").rowsBetween(Window.unboundedPreceding, 0)
        inside = times.filter(F.col("range") == cut["range"]).select("time", (F.sum("size").over(order) + F.lit(cut["served"])).alias("sum"))
        earlier = times.filter(F.col("range") < cut["range"]).agg(F.max("time").alias("t")).first()["t"]
        within_budget = inside.filter(F.col("sum") <= F.lit(budget)).agg(F.max("time").alias("t")).first()["t"]
        until = float(within_budget if within_budget is not None else earlier if earlier is not None else -1.0)
    taken = F.coalesce(F.size(F.filter("finish", lambda t: t <= F.lit(until))), F.lit(0)) * F.col("size")
    return queue.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.when(F.col("finish").isNull(), F.lit(0)).otherwise(taken).cast("long").alias("taken"), *[F.col(k).alias(c) for c, k in mine.items()])


def oracle(weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, repeats: int = 2, seed: int = 7) -> str:
    """The same mix of `documents` in DuckDB's SQL."""
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
                      md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS place FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT source, source_size, source_size * {repeats} AS cap,
                 list_extract({list(weights)}, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::BIGINT)::BIGINT AS weight FROM s),
    o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
                 coalesce(sum(cap) OVER f, 0) AS caps, coalesce(sum(weight) OVER f, 0) AS used FROM w WHERE cap > 0
          WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT max((total::DOUBLE * {percent} / 100.0::DOUBLE - caps::DOUBLE) / (weights - used)::DOUBLE) AS level FROM o),
    t AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM w, l),
    q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY place, size ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    f AS (SELECT q.source, size, place, ((n * source_size + ends)::DOUBLE / target) AS time FROM q, range({repeats}) r(n) WHERE size > 0),
    g AS (SELECT time, sum(size) OVER (ORDER BY time, place, source, size ROWS UNBOUNDED PRECEDING) AS upto FROM f),
    u AS (SELECT coalesce(max(time), -1) AS until FROM g WHERE upto <= (SELECT sum(target) FROM t))
    SELECT doc_id, size, source_size, target,
           (CASE WHEN size > 0 THEN size * ({' + '.join(f'CASE WHEN ({n} * source_size + ends)::DOUBLE / target <= until THEN 1 ELSE 0 END' for n in range(repeats))}) ELSE 0 END)::BIGINT AS taken
    FROM q, u"""
