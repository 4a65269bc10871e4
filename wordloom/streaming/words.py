"""Streaming word tables: daily frequencies by event time, operators per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.workdir import CLEANUP, settings
from .articles import dedupe_stream
from .log import BatchLog

# Shuffle files go with the job that made them; few texts at a time are packed to be kept.
BATCH_SETTINGS = {CLEANUP: "true", "spark.sql.inMemoryColumnarStorage.batchSize": "500"}


def daily_counts(words: DataFrame, event_time: str, lateness: str = "1 day") -> DataFrame:
    """Count per (date, language, type, word) by event time; for streams and tables alike.

    Days are those of the session's time zone. In append mode a day is emitted once it is
    ``lateness`` behind the newest event.
    """
    # Windows start at midnight UTC, so local clock time is moved there and the day read from it.
    clock = F.from_utc_timestamp(F.col(event_time).cast("timestamp"), F.current_timezone())
    words = words.withColumn(event_time, clock)
    day = F.window(event_time, "1 day")
    counted = (
        words.withWatermark(event_time, lateness)
        .groupBy(day.alias("day"), "language", "type", "word")
        .agg(F.sum("count").alias("count"))
    )
    since_1970 = F.floor(F.unix_seconds("day.start") / F.lit(86400)).cast("int")
    return counted.select(
        F.date_from_unix_date(since_1970).alias("date"), "language", "type", "word", "count"
    )


def start_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to Parquet files, stop when the input is used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def start_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows of an aggregation that a batch changed, one folder per batch.

    Nothing is rewritten, a batch that runs again overwrites its own folder, and a watermark in
    ``df`` frees the state of finished days. ``latest_rows`` gives the current result.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_rows(updates: DataFrame, keys: Sequence[str], value: str = "count") -> DataFrame:
    """The current value per key of what ``start_updates`` has written (with its column batch)."""
    newest = F.max(F.struct("batch", value)).alias("newest")
    return updates.groupBy(*keys).agg(newest).select(*keys, F.col(f"newest.{value}").alias(value))


def start_current(
    df: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    split: str = "date",
    value: str = "count",
    compact_every: int = 20,
) -> StreamingQuery:
    """Like ``start_updates``, with bases: every ``compact_every`` batches what the batches before changed is
    merged into the base of each ``split`` value they touch, so ``current_rows`` reads a base and few batches."""
    schema = df.select(*keys, value).schema
    log = BatchLog(df.sparkSession, path, schema, split, create=True)

    def store(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            log.compact(batch_id - 1, lambda rows: latest_rows(rows, keys, value))
        log.write(batch, batch_id)

    return (
        df.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def current_rows(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], split: str = "date", value: str = "count"
) -> DataFrame:
    """The current value per key of what ``start_current`` has written: bases and newer batches only."""
    return latest_rows(BatchLog(spark, path, schema, split).read(), keys, value)


def start_operator(
    df: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    *,
    document_id: str | None,
    event_time: str | None = None,
    horizon: str = "30 days",
) -> StreamingQuery:
    """Run any DataFrame -> DataFrame operator on each micro-batch.

    Rows whose ``document_id`` an earlier batch (or row) has brought are left out first, from the
    stream's state (see ``dedupe_stream``); None for rows that may repeat, such as words. Lists the
    operator reads are loaded when it runs, so a batch sees their current content. Each batch has
    its own folder and may be run again. Operators that need the whole corpus (word index,
    trends, topics) give wrong results per batch; run those on the stored output.

    Operators may read a batch several times (to measure its texts, say): it is kept while it is worked on, so
    that the state is asked once, and what its jobs shuffled goes with them.
    """
    if document_id is not None:
        df = dedupe_stream(df, document_id, event_time, horizon)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            operator(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    # A stream takes the settings it is started with.
    with settings(df.sparkSession, BATCH_SETTINGS):
        return (
            df.writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
