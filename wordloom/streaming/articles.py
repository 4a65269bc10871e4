"""Streaming ingest of crawled JSON lines."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.frames import first_per_key
from ..operators.articles import parse_article_lines, rejected
from ..schemas import ARTICLES
from .memory import BUCKETS, IdMemory

_BATCH = "batch"


def dedupe_stream(
    df: DataFrame, key: str = "text_id", event_time: str | None = None, horizon: str = "30 days"
) -> DataFrame:
    """Each key once: within ``horizon`` of event time, or for ever without an event time.

    Without an event time the state holds every key ever seen and only grows. All copies of a key
    travel to its state; where one key has very many copies, ``start_ingest`` reduces them first.
    """
    if event_time is None:
        return df.dropDuplicates([key])
    return df.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def stream_articles(
    lines: DataFrame,
    media: Column | str,
    crawl_date: Column | Date | str,
    event_time: str | None = None,
    horizon: str = "30 days",
) -> DataFrame:
    """Good articles of a stream of JSON lines, each id once (see ``dedupe_stream``)."""
    keep = [event_time] if event_time else []
    parsed = parse_article_lines(lines, media, crawl_date, keep=keep)
    good = parsed.where(F.col("reject_reason").isNull()).select(*ARTICLES.names, *keep)
    return dedupe_stream(good, "text_id", event_time, horizon).select(ARTICLES.names)


def start_ingest(
    lines: DataFrame,
    media: Column | str,
    crawl_date: Column | Date | str,
    articles_path: str,
    rejects_path: str,
    checkpoint: str,
    counts_path: str | None = None,
    buckets: int = BUCKETS,
    compact_every: int = 50,
) -> StreamingQuery:
    """Ingest what is available, then stop: articles and rejects, one folder per batch.

    Ids are remembered in hash buckets beside the articles (see ``IdMemory``), so a batch reads neither the
    articles nor all ids, nothing has to stay in state, and copies within a batch are reduced before any
    shuffle. Every ``compact_every`` batches the memory is compacted. With ``counts_path`` each batch
    stores how many lines it had, how many were rejected, repeated or stored. A batch that is run again
    overwrites its own folders, so a failure leaves no article twice.
    """
    spark = lines.sparkSession
    empty = spark.createDataFrame([], ARTICLES)
    empty.write.mode("overwrite").parquet(f"{articles_path}/{_BATCH}=-1")
    memory = IdMemory(spark, f"{articles_path}-ids", buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            memory.compact(batch_id - 1)
        parsed = parse_article_lines(batch, media, crawl_date).persist()
        good = parsed.where(F.col("reject_reason").isNull()).drop("line", "reject_reason")
        fresh = first_per_key(good, ["text_id"], ["index", "media", "url"]).select(ARTICLES.names)
        seen = Observation()
        fresh = memory.unseen(fresh, batch_id).observe(seen, F.count(F.lit(1)).alias("articles"))
        path = f"{articles_path}/{_BATCH}={batch_id}"
        fresh.write.mode("overwrite").parquet(path)
        # Read back: the ids that are remembered are those that were stored.
        memory.remember(batch.sparkSession.read.schema(ARTICLES).parquet(path), batch_id)
        rejected(parsed).write.mode("overwrite").parquet(f"{rejects_path}/{_BATCH}={batch_id}")
        if counts_path is not None:
            bad = F.count("reject_reason")
            stored = F.lit(seen.get["articles"])
            counted = parsed.agg(
                F.count(F.lit(1)).alias("lines"), bad.alias("rejected"),
                (F.count(F.lit(1)) - bad - stored).alias("repeated"), stored.alias("articles"),
            )
            counted.write.mode("overwrite").parquet(f"{counts_path}/{_BATCH}={batch_id}")
        parsed.unpersist()

    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
