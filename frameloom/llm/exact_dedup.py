"""Exact duplicates by a 128-bit content hash whose groups are held together by their bytes; DataFrame operations only.

Rows meet by the hash of their normalised text, never by the text: one
aggregation with partial sums finds a group's size and the row that stays, so
a group of any size is one row for each task. Whether equal hashes stand for
equal bytes is checked on the texts themselves: each distinct text of a group
travels once per task, and a hash that two different texts share is split by
text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .components import looked_up

#: Characters that normalising deletes: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: With no more groups of several rows than this (16 bytes each), their hashes are broadcast and only their texts are compared; beyond it, all texts are.
MOST_BROADCAST = 1 << 20


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ignored: str = WHITE) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal if they are after deleting the characters of `ignored`;
    null counts as empty, and all texts without other characters are one group.
    Of equal texts the row with the most code points stays, then the smallest
    id (null last), then the first row, so a repeated row is a copy of its own
    and one of its group has kept = true. Ids may be of any type that sorts;
    other columns of docs are not looked at. A text is held once by the task
    that reads it, whatever its length.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), ignored, text)
    named = docs.select(F.col(id_col).alias("_id"), plain.alias("plain"), F.char_length(text).alias("size"))
    read = named.select("_id", "size", "plain", F.unhex(F.md5(F.col("plain").cast("binary"))).alias("hash"), F.sha2(F.col("plain").cast("binary"), 256).alias("sha"), F.monotonically_increasing_id().alias("rid"))
    rows = read.withColumns({"sha": F.unhex("sha"), "part": F.lit(0)}).drop("plain").checkpoint()
    several = rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash").checkpoint()
    if several.isEmpty():
        texts = None
    elif several.count() <= MOST_BROADCAST:
        texts = read.select("hash", "plain").join(F.broadcast(several), "hash", "left_semi")
    else:
        texts = read.select("hash", "plain")
    if texts is not None:
        rows = split_by_bytes(rows, read, texts)
    # Most code points first; nulls of a struct sort first, so whether an id is null stands before it.
    order = F.struct((-F.col("size")).alias("size"), F.col("_id").isNull().alias("none"), "_id", "rid")
    best = rows.groupBy("hash", "part").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).checkpoint()
    told = looked_up(rows, best, ["hash", "part"])
    return told.select(F.col("_id").alias(id_col), F.col("best._id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def split_by_bytes(rows: DataFrame, read: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows, those of a hash that different texts share with `part`, the number of their text among these texts."""
    distinct = texts.distinct()
    shared = distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash").checkpoint()
    if shared.isEmpty():
        return rows
    number = (F.row_number().over(Window.partitionBy("hash").orderBy("plain")) - 1).alias("part")
    parts = distinct.join(shared, "hash", "left_semi").select("hash", "plain", number)
    clash = read.join(shared, "hash", "left_semi").join(parts, ["hash", "plain"]).withColumn("sha", F.unhex("sha"))
    return rows.join(shared, "hash", "left_anti").unionByName(clash.select(rows.columns)).checkpoint()
