"""Memory of the ids that earlier batches brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .log import BATCH, BatchLog

BUCKETS = 64
# Bits of one filter row, and ids that share one: with 16 bits an id, one in sixteen new ids looks known.
_BITS, _PER_ROW = 1 << 15, 1 << 11


def _hash(column: Column) -> Column:
    return F.xxhash64(column, F.lit(5))


class IdMemory:
    """Ids in hash buckets, each bucket with a small filter.

    A batch reads the filters of the buckets that its ids fall in, and the ids of a bucket only where the filter
    knows one of them; so a batch of new ids hardly reads ids, however many are stored. Without
    ``compact`` every batch leaves a file per bucket it touches.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.buckets = buckets
        ids = StructType.fromDDL("text_id bigint, bucket int")
        filters = StructType.fromDDL("slots int, slot int, bits binary, bucket int")
        self.ids = BatchLog(spark, f"{path}/ids", ids, "bucket", create=True)
        self.filters = BatchLog(spark, f"{path}/filters", filters, "bucket", create=True)

    def _bucketed(self, ids: DataFrame) -> DataFrame:
        ids = ids.select("text_id").where("text_id is not null").distinct()
        return ids.withColumn("bucket", F.pmod(F.xxhash64("text_id"), F.lit(self.buckets)).cast("int"))

    @staticmethod
    def _filters(ids: DataFrame) -> DataFrame:
        """Bit maps of the ids of each bucket, as many as keep them thin."""
        # One row per bucket: their number is fixed.
        slots = ids.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / _PER_ROW).cast("int").alias("slots"))
        placed = ids.join(F.broadcast(slots), "bucket").withColumn("h", _hash(F.col("text_id")))
        slot = F.pmod(F.shiftright("h", 15), "slots").cast("int")
        bit = F.col("h").bitwiseAND(F.lit(_BITS - 1))
        return placed.groupBy("bucket", "slots", slot.alias("slot")).agg(F.bitmap_construct_agg(bit).alias("bits"))

    def remember(self, ids: DataFrame, batch: int) -> None:
        """Store the ids of a batch; running it again replaces them."""
        own = self._bucketed(ids).repartition("bucket").persist()  # one file per bucket
        self.ids.write(own, batch, by_split=True)
        self.filters.write(self._filters(own), batch)
        own.unpersist()

    def maybe_known(self, ids: DataFrame, batch: int) -> DataFrame:
        """(text_id, bucket) of the distinct ids that a filter of earlier batches holds: all known ones, few others."""
        own = self._bucketed(ids)
        touched = None
        if self.filters.compacted() >= 0:  # bases are split by bucket
            touched = [r[0] for r in own.select("bucket").distinct().collect()]  # one number per bucket at most
        filters = self.filters.read(batch, touched).drop(BATCH).withColumnRenamed("bucket", "of")
        h = _hash(F.col("text_id"))
        bit = h.bitwiseAND(F.lit(_BITS - 1))
        byte = F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        is_set = value.bitwiseAND(F.expr("shiftleft(1, cast(xxhash64(text_id, 5) & 7 as int))")) != 0
        met = own.join(filters, (F.col("bucket") == F.col("of")) & (F.pmod(F.shiftright(h, 15), "slots") == F.col("slot")))
        return met.where(is_set).select("text_id", "bucket").distinct()

    def stored(self, batch: int, buckets: list[int]) -> DataFrame:
        """The ids that batches before one have stored in these buckets; other buckets' files are not read."""
        return self.ids.read(batch, buckets).select("text_id")

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """Rows whose text_id no batch before has stored."""
        if batch == 0:
            return rows
        maybe = self.maybe_known(rows, batch).persist()
        buckets = [r[0] for r in maybe.select("bucket").distinct().collect()]
        if not buckets:
            maybe.unpersist()
            return rows
        known = maybe.join(self.stored(batch, buckets), "text_id", "left_semi").select("text_id")
        return rows.join(known, "text_id", "left_anti")

    def compact(self, through: int) -> None:
        """Merge the files of the batches up to ``through`` to one per bucket, filters too."""
        self.ids.compact(through, lambda rows: rows.select("text_id", "bucket").distinct())
        # The filters are made anew from the ids, so that they stay thin.
        self.filters.compact(
            through, lambda rows: self._filters(self.ids.read(through + 1).select("text_id", "bucket").join(
                rows.select("bucket").distinct(), "bucket", "left_semi"))
        )
