"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


MOST_PARTITIONS = 200_000


def settings_for(
    input_bytes: int, cores: int, partition_bytes: int = 128 * 1024 * 1024
) -> dict[str, str]:
    """Shuffle settings for an input size: enough partitions that one fits an executor core.

    Adaptive execution merges partitions that turn out small but does not split ordinary shuffles,
    so the starting number has to be high enough.
    """
    # Beyond MOST_PARTITIONS the bookkeeping of map outputs on the driver costs more than it saves:
    # partitions grow instead, in the scan as in the shuffle.
    partition_bytes = max(partition_bytes, -(-input_bytes // MOST_PARTITIONS))
    partitions = max(cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def build_session(
    app_name: str = "wordloom", master: str | None = None, **extra: str
) -> SparkSession:
    """Create (or reuse) a session; ``extra`` overrides the settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
