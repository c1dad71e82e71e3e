"""Labels kept up to date batch by batch against the whole log evaluated anew."""

import random

from pyspark.sql import functions as F

from frameloom.operators import metrics
from frameloom.streaming import labels


def test_every_batch_equals_the_whole_log(spark, tmp_path):
    rng = random.Random(8)
    samples = [(k, rng.choice(("LOGIC", "DETECTED", None)), rng.choice((0, 1, 1, -1, None))) for k in range(40)]
    log = [(rng.randrange(42), seq, rng.choice((0, 1, 1, 2, None))) for seq in range(200)]
    log += log[:10]
    arrived = sorted(log, key=lambda r: r[1] + rng.uniform(0, 60))
    known = spark.createDataFrame(samples, "sample_id long, qc_mode string, predicted int")
    source, kept = str(tmp_path / "log"), str(tmp_path / "kept")
    parts = [arrived[:70], arrived[70:140], arrived[140:]]
    for part in parts:
        spark.createDataFrame(part, labels.LOG).coalesce(1).write.mode("append").parquet(source)
    stream = labels.differences(spark.readStream.schema(labels.LOG).option("maxFilesPerTrigger", 1).parquet(source), known)
    q = stream.writeStream.outputMode("update").foreachBatch(labels.keep(kept)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    text = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    for k in range(3):
        so_far = spark.createDataFrame([r for p in parts[: k + 1] for r in p], labels.LOG)
        want = metrics.confusion(metrics.latest(so_far).join(known, "sample_id"), F.col("predicted"), F.col("label"), ("qc_mode",))
        got = labels.metrics(spark.read.parquet(f"{kept}/batch={k}"))
        assert text(got.select(want.columns)) == text(want), k
    # A label that is given again changes nothing.
    assert labels.differences(spark.createDataFrame([(1, 5, 1), (1, 5, 1), (1, 4, 0)], labels.LOG), known.filter("sample_id = 1")).count() == 1
