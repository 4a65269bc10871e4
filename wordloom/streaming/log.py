"""Rows that micro-batches add, with compacted bases that stand for the batches before."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

BATCH, THROUGH = "batch", "through"


class BatchLog:
    """A table of one folder per batch, and of compacted bases split by a column.

    A batch that runs again overwrites its folder. ``compact`` merges what the batches up to one have added into a
    base: it rewrites only the values of ``split`` that those batches touch, each value's newest base
    counts, and a mark says up to which batch bases hold, so readers see a base only when it is complete.
    Batches at ``path``, bases and marks beside it. Folders a base replaces are no longer read; a retention
    rule may remove them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, split: str, create: bool = False):
        self.spark, self.path, self.split = spark, path.rstrip("/"), split
        self.columns = schema.names
        self.schema = schema
        self._through: int | None = None
        if create:  # folders without rows, so that there is something to read
            empty = spark.createDataFrame([], schema).coalesce(1)
            self._write(empty, f"{self.path}/{BATCH}=-1", [split])
            self._write(empty, f"{self.path}-base/{THROUGH}=-1", [split])
            self._write(self._mark(-1), f"{self.path}-marks/mark=-1")

    def _mark(self, through: int) -> DataFrame:
        return self.spark.range(1, numPartitions=1).select(F.lit(through).cast("long").alias(THROUGH))

    @staticmethod
    def _write(rows: DataFrame, path: str, split: Sequence[str] = ()) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*split) if split else writer).parquet(path)

    def write(self, rows: DataFrame, batch: int, by_split: bool = False) -> None:
        """Add the rows of a batch, or replace them when it runs again; ``by_split`` stores them by its values."""
        self._write(rows.select(*self.columns), f"{self.path}/{BATCH}={batch}", [self.split] if by_split else ())

    def compacted(self) -> int:
        """The last batch that bases hold, -1 without any; read once, then known from ``compact``."""
        if self._through is None:
            marks = self.spark.read.schema(f"{THROUGH} long").parquet(f"{self.path}-marks")
            self._through = marks.agg(F.max(THROUGH)).first()[0]
        return self._through

    def _stored(self, folder: str, key: str) -> DataFrame:
        fields = [f for f in self.schema.fields if f.name != self.split]
        schema = StructType([*fields, StructField(key, LongType()), self.schema[self.split]])
        return self.spark.read.schema(schema).parquet(folder)

    def newer(self, before: int | None = None) -> DataFrame:
        """Rows of the batches that no base holds yet, with their batch."""
        rows = self._stored(self.path, BATCH).where(F.col(BATCH) > self.compacted())
        rows = rows if before is None else rows.where(F.col(BATCH) < before)
        return rows.select(*self.columns, BATCH)

    def base(self) -> DataFrame:
        """Rows of the newest base of each value of ``split``, under the batch up to which bases hold."""
        through = self.compacted()
        bases = self._stored(f"{self.path}-base", THROUGH).where((F.col(THROUGH) >= 0) & (F.col(THROUGH) <= through))
        newest = bases.groupBy(F.col(self.split).alias("__of")).agg(F.max(THROUGH).alias("__newest"))
        rows = bases.join(newest, F.col(self.split).eqNullSafe(F.col("__of")) & (F.col(THROUGH) == F.col("__newest")))
        return rows.select(*self.columns, F.lit(through).cast("long").alias(BATCH))

    def read(self, before: int | None = None, only: Sequence | None = None) -> DataFrame:
        """All rows, with their batch: bases and newer batches, of ``only`` these values of ``split``."""
        rows = self.newer(before)
        if self.compacted() >= 0:
            rows = self.base().unionByName(rows)
        return rows if only is None else rows.where(F.col(self.split).isin(list(only)))

    def compact(self, through: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Make bases hold the batches up to ``through``; ``merge`` gets base and batch rows of touched values.

        The batch that may still run again must not be among them.
        """
        if through <= self.compacted():
            return
        touched = self.newer(through + 1).select(F.col(self.split).alias("__of")).distinct()
        rows = self.read(through + 1).join(touched, F.col(self.split).eqNullSafe(F.col("__of")), "left_semi")
        merged = merge(rows).select(*self.columns)
        self._write(merged.hint("rebalance", self.split), f"{self.path}-base/{THROUGH}={through}", [self.split])
        self._write(self._mark(through), f"{self.path}-marks/mark={through}")
        self._through = through
