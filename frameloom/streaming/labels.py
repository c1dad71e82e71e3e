"""Labels as they are given: each sample's last label counts, and a table of confusion cells is kept up to date by what changes.

A label that replaces another moves its sample from one cell of the matrix to
another, so a batch of labels is a batch of differences, and the table is the
sum of all differences so far. Labels may arrive out of order and more than
once: the greatest seq of a sample counts. A null label takes a label back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import share
from .state import use_state_store

LOG = "sample_id long, seq long, label int"
#: change is 1 for the cell that a sample enters and -1 for the one that it leaves.
DIFFERENCES = "qc_mode string, cell string, sample_id long, change long"
#: Of a label and a prediction of 0 or 1; other predictions are invalid, other labels only count as labelled.
CELLS = {(1, 1): "TP", (1, 0): "FP", (0, 1): "FN", (0, 0): "TN"}


def cell(predicted: int | None, label: int | None) -> str | None:
    if label is None:
        return None
    return CELLS.get((predicted, label), "other") if predicted in (0, 1) else "invalid"


class Latest(StatefulProcessor):
    """One sample: what was predicted and its last label."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sample = handle.getValueState("sample", "qc_mode string, predicted int")
        self.last = handle.getValueState("last", "seq long, label int")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.sample.update((initialState["qc_mode"], initialState["predicted"]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq, old = self.last.get() if self.last.exists() else (None, None)
        newest = max(rows, key=lambda r: r["seq"])
        if not self.sample.exists() or (seq is not None and newest["seq"] <= seq):
            return
        self.last.update((newest["seq"], newest["label"]))
        mode, predicted = self.sample.get()
        before, after = cell(predicted, old), cell(predicted, newest["label"])
        make = Row("qc_mode", "cell", "sample_id", "change")
        if before != after:
            for at, change in ((before, -1), (after, 1)):
                if at is not None:
                    yield make(mode, at, key[0], change)

    def close(self) -> None:
        pass


def differences(log: DataFrame, samples: DataFrame) -> DataFrame:
    """The differences (DIFFERENCES) that a stream or a table of labels (LOG) makes for samples (sample_id, qc_mode, predicted); labels of unknown samples make none."""
    use_state_store(log.sparkSession)
    known = samples.select("sample_id", "qc_mode", F.col("predicted").cast("int").alias("predicted"))
    return log.groupBy("sample_id").transformWithState(Latest(), DIFFERENCES, "update", "none", known.groupBy("sample_id"))


def totals(found: DataFrame) -> DataFrame:
    """qc_mode, cell, n: the sums of differences."""
    return found.groupBy("qc_mode", "cell").agg(F.sum("change").alias("n")).filter("n <> 0")


def metrics(cells: DataFrame) -> DataFrame:
    """Confusion matrix and rates of each mode, as metrics.confusion gives them, from totals."""
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("cell").isin(*names), F.col("n"))), F.lit(0)).cast("long")
    m = cells.groupBy("qc_mode").agg(*[n(c).alias(c) for c in ("TP", "FP", "FN", "TN")], n("TP", "FP", "FN", "TN", "other").alias("total_labeled"), n("invalid").alias("invalid"))
    right = F.col("TP") + F.col("TN")
    every = right + F.col("FP") + F.col("FN")
    return m.withColumns({"accuracy": share(right, every), "error_rate": share(F.col("FP") + F.col("FN"), every), "sensitivity": share(F.col("TP"), F.col("TP") + F.col("FN")), "specificity": share(F.col("TN"), F.col("TN") + F.col("FP"))})


def keep(path: str):
    """A foreachBatch function that keeps a table of totals in `path`: a folder for each batch, made of the one before and the batch's differences, so a batch that is run again makes the same."""

    def put(batch: DataFrame, number: int) -> None:
        now = totals(batch)
        if number:
            before = batch.sparkSession.read.parquet(f"{path}/batch={number - 1}")
            now = before.unionByName(now).groupBy("qc_mode", "cell").agg(F.sum("n").alias("n")).filter("n <> 0")
        now.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put
