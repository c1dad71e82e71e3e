"""Stages that only tell which rows stay write no text to the checkpoint folder."""

import os
import random
from collections import Counter
from pathlib import Path

import corpus_pipeline as p
from pyspark.sql import functions as F

from frameloom.llm import toxicity
from frameloom.llm.common import parts_for, pinned, prepare, release
from frameloom.llm.components import parted


def written(folder):
    return sum(os.path.getsize(f) for f in Path(folder).rglob("*") if f.is_file())


def test_toxicity_and_mix_leave_texts_where_they_are(spark, tmp_path):
    rng = random.Random(4)  # no long text has a label, as learning writes its own counts
    rows = [(10**7 + k, " ".join(f"{rng.getrandbits(60):x}" for _ in range(1500)), "ab"[k % 2]) for k in range(80)]
    rows += [(k, "you are an idiot and a moron" if k % 2 else "a fine day by the sea", "a") for k in range(60)] + [(10**8, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    prepare(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    texts = sum(len(r[1] or "") for r in rows)
    for stage, most in ((p.drop_toxic, 1), (p.mix_sources, 2)):
        before = written(folder)
        out = stage(spark, docs, str(tmp_path))
        assert pinned(out) is out
        release(spark)
        assert written(folder) - before < texts / 10
        got = Counter(r["doc_id"] for r in out.collect())
        assert max(got.values()) == most
        if most == 1:
            score = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), F.lit(True)).column(F.col("text"))
            assert set(got) == {r["doc_id"] for r in docs.filter(score < p.TOXIC).collect()}
            assert 10**8 in got
        assert [r["rid"] for r in out.select(F.monotonically_increasing_id().alias("rid")).collect()] == [r["rid"] for r in out.select(F.monotonically_increasing_id().alias("rid"), F.md5("text")).collect()]


def test_rows_told_by_a_broadcast_are_not_taken_for_a_product(spark):
    prepare(spark)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("rid", F.monotonically_increasing_id())
    some = parted(rows, rows.filter("doc_id % 2 = 0").select("rid").checkpoint())[0]
    assert pinned(some) is some
    assert parts_for(some) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    shuffled = some.join(rows.select("rid"), "rid")  # may deal its rows otherwise in another reading
    assert pinned(shuffled) is not shuffled
