"""Small helpers on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .joins import BROADCAST_MAX_ROWS, fits_broadcast
from .masks import keys_present, sum_counts


def as_word_table(
    spark: SparkSession, words: DataFrame | Iterable[str]
) -> tuple[DataFrame, bool]:
    """Distinct ``word`` rows of a list or of a table's ``word`` (or first) column.

    Also says whether they are few enough to broadcast; measured before removing repeats.
    """
    if isinstance(words, DataFrame):
        name = "word" if "word" in words.columns else words.columns[0]
        table = words.select(F.col(name).alias("word")).where(F.col("word").isNotNull())
        return table.distinct(), fits_broadcast(table)
    rows = [(w,) for w in dict.fromkeys(words) if w is not None]
    return spark.createDataFrame(rows, "word string"), len(rows) <= BROADCAST_MAX_ROWS


def first_per_key(
    df: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the smallest by ``order_by``, ties broken by all other columns.

    An aggregation, not a window: each task first reduces its own copies of a key to one row, so a
    key with very many copies never meets in one task.
    """
    order = list(order_by or [])
    rest = [c for c in df.columns if c not in key and c not in order]
    ranked = [c for c in order if c not in key] + rest
    if not ranked:
        return df.dropDuplicates(list(key))
    best = F.min(F.struct(*ranked)).alias("__first")
    return (
        df.groupBy(*key).agg(best).select(*key, "__first.*").select(*df.columns)
    )


# Bytes of text that one task counts the words of: its rows of words take about eighty times as much memory.
TEXT_BYTES_PER_TASK = 4 * 1024 * 1024
# Rows of words that one task sums: about 200 MB.
WORD_ROWS_PER_TASK = 500_000


def deal_texts(df: DataFrame, key: str, text: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """``df`` dealt by ``key``, with so many partitions that none holds many more bytes than a task should have.

    Session settings do not bound that: adaptive execution merges partitions up to 64 MB as compressed, which is
    gigabytes of words. One job measures the texts. A key whose copies weigh more than a task's share is
    reduced to its first row (``first_per_key``) before the texts move, so that it never meets in one task;
    the other copies are kept.
    """
    if df.isStreaming:
        return df
    weight = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 16
    per_key = df.groupBy(F.col(key).alias("__key")).agg(F.sum(weight).alias("b"), F.count(F.lit(1)).alias("n"))
    heavy = (F.col("n") > 1) & (F.col("b") > TEXT_BYTES_PER_TASK)
    found = per_key.agg(F.sum("b").alias("b"), F.max(heavy.cast("int")).alias("heavy")).first()
    partitions = max(df.sparkSession.sparkContext.defaultParallelism, -(-(found["b"] or 0) // TEXT_BYTES_PER_TASK))
    if found["heavy"]:
        # At most one key per share of the texts.
        hot = F.broadcast(per_key.where(heavy).select("__key"))
        same = F.col(key).eqNullSafe(F.col("__key"))
        reduced = first_per_key(df.join(hot, same, "left_semi"), [key], order_by)
        df = df.join(hot, same, "left_anti").unionByName(reduced)
    return df.repartition(partitions, key)


def word_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows of words."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // WORD_ROWS_PER_TASK))


def sum_word_rows(rows: DataFrame, keys: Sequence[str], words: DataFrame) -> DataFrame:
    """Total ``count`` per key of rows made from a table of counted words.

    Nearly every key of such rows occurs once, so a partial sum in the task that reads them would hold them all and
    spare the shuffle nothing. They are dealt by key first, over as many partitions as the table ``words`` has
    rows for (a stored one knows its count).
    """
    partitions = word_partitions(rows.sparkSession, words.count())
    return sum_counts(rows.where(keys_present(keys)).repartition(partitions, *keys), keys)


def duplicate_report(df: DataFrame, keys: Sequence[str], wide: bool = False) -> DataFrame:
    """One row: how many rows there are and how many repeat an earlier row's key.

    ``wide`` keys, such as whole texts, are shuffled as 256-bit digests.
    """
    by = [F.unhex(F.sha2(F.col(k).cast("string"), 256)).alias(k) for k in keys] if wide else list(keys)
    per_key = df.select(*by).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("num_duplicates"),
    )


def count_rows(df: DataFrame, observation) -> DataFrame:
    """Report the row count of this step through an ``Observation`` without an extra job."""
    if observation is None:
        return df
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))
