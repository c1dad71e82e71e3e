"""Connected components by alternating star contractions, and joins that a hot key cannot stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than 1 / HOT_SHARE of the left rows, so there are fewer than HOT_SHARE hot keys; and with more rows than LEAST_HOT.
HOT_SHARE, LEAST_HOT = 4096, 1000
#: Words of 64 marks that are broadcast at most (some 40 MB, for 2^26 rows or more).
MARKS = 1 << 20


def looked_up(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of left with a table that has at most one row for each key.

    Rows of hot keys stay where they are: the rows of `right` for these keys,
    fewer than HOT_SHARE whatever the tables hold, are broadcast. All others
    are shuffled, and no key among them has more than its share. Both sides are read
    several times and should be checkpoints.
    """
    counted = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = left.count()
    hot = counted.filter(F.col("_n") > max(LEAST_HOT, total // HOT_SHARE)).drop("_n").checkpoint()
    if hot.isEmpty():
        return left.join(right, keys)
    told = right.join(F.broadcast(hot), keys, "left_semi")
    return left.join(F.broadcast(told), keys).unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys))


def parted(rows: DataFrame, rids: DataFrame, row: str = "rid") -> tuple[DataFrame, DataFrame]:
    """The rows whose number (the column `row`, never null) is in rids (one column, rid), and all others.

    A bit for each row is broadcast, 64 to a word, so that rows stay where they
    are and only what a later step needs is shuffled; with more than MARKS
    words, all rows are. rids is read twice and should be a checkpoint.
    """
    word, bits = "_word", "_bits"
    while {word, bits} & {c.lower() for c in rows.columns}:
        word, bits = f"{word}_", f"{bits}_"
    marks = rids.groupBy(F.shiftright("rid", 6).alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(rid % 64 as int)))").alias(bits)).checkpoint()
    if marks.count() > MARKS:
        told = rids.select(F.col("rid").alias(row)).distinct()
        return rows.join(told, row, "left_semi"), rows.join(told, row, "left_anti")
    marked = rows.withColumn(word, F.shiftright(row, 6)).join(F.broadcast(marks), word, "left")
    bit = F.coalesce(F.getbit(bits, (F.col(row) % 64).cast("int")), F.lit(0))
    return marked.filter(bit == 1).drop(word, bits), marked.filter(bit == 0).drop(word, bits)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it can reach) of every node of edges (a, b); nodes without an edge have no row.

    Each round joins every node to the least of its neighbours and itself, in
    two steps: larger neighbours first (large star), then smaller ones (small
    star). Both steps are one aggregation with partial results and one join; the rows of
    a node with very many neighbours are joined where they are (`looked_up`).
    Rounds grow with the logarithm of the longest path. Every round is checkpointed.
    """
    both = edges.filter("a is not null and b is not null and a <> b")
    now = both.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().checkpoint()
    seen = None
    while True:
        # Large star: the larger neighbours of each node are joined to the least of it and its neighbours.
        least = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(now.select("lo", "lo")).groupBy("n").agg(F.min("m").alias("least")).checkpoint()
        large = looked_up(now.select(F.col("lo").alias("n"), F.col("hi").alias("m")), least, ["n"]).select(F.col("least").alias("lo"), F.col("m").alias("hi")).filter("lo <> hi").distinct().checkpoint()
        # Small star: a node and its smaller neighbours are joined to the least of these.
        least = large.groupBy("hi").agg(F.min("lo").alias("least")).checkpoint()
        small = looked_up(large, least, ["hi"]).select("least", F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("other"), "hi")
        after = small.select(F.col("least").alias("lo"), F.explode(F.array("hi", "other")).alias("hi")).filter("lo <> hi").distinct().checkpoint()
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if sign == seen:
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(after.select("lo", "lo").distinct())
        seen, now = sign, after
