"""The session's state store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def use_state_store(spark: SparkSession) -> None:
    """Keeps operators' state in RocksDB; the session's streams are asked for once, as the store of a query over a table reports to their coordinator too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams.active
