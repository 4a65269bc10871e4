"""Shared folder for checkpoints and tables that jobs write on the way."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse, which every executor reaches as well.
    """
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_wordloom"


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that are planned inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# For tables that Python makes of texts: Spark's own bound is 64 MB, held by the JVM and by the worker.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "12m"}


def settle(df: DataFrame, name: str = "table", planned: dict[str, str] | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back, cutting its lineage.

    The shuffle files of the job that writes it go when it ends, as nothing reads them after the table is stored.
    ``planned``: session settings that the job is planned with.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {CLEANUP: "true", **(planned or {})}):
        df.select("*").write.parquet(path)  # a new plan, which takes the settings
    return spark.read.schema(df.schema).parquet(path)
