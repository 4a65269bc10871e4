"""Word frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.masks import one_of, sum_counts
from ..schemas import canonical_names, require_columns


def word_frequency(
    words: DataFrame,
    word_types: Sequence[str] | None = None,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Total count per (language, type, word)."""
    require_columns(words, ["language", "type", "word", "count"], "word_frequency")
    rows = words.where(one_of("type", word_types) & one_of("language", languages))
    rows = rows.withColumn("count", F.col("count").cast("bigint"))
    return sum_counts(rows, ["language", "type", "word"])


def daily_word_frequency(
    index: DataFrame,
    metadata: DataFrame,
    language: str | None = None,
    types: Sequence[str] | None = None,
    min_count: int = 1,
) -> DataFrame:
    """Total count per (date, language, type, word), kept from ``min_count`` on.

    Filters and columns reach both scans before the join on id. Repeated metadata rows of an id
    and date are counted first, so a text stored very often stays small in the join; both sides
    are then shuffled by id as they are, which lets adaptive execution split an id with very many
    rows.
    """
    index, metadata = canonical_names(index), canonical_names(metadata)
    require_columns(index, ["text_id", "language", "type", "word", "count"], "daily_word_frequency")
    require_columns(metadata, ["text_id", "date"], "daily_word_frequency")
    rows = index.where(one_of("language", [language] if language else None) & one_of("type", types))
    dates = (
        metadata.where(F.col("text_id").isNotNull())
        .groupBy("text_id", "date")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    dated = rows.select("text_id", "language", "type", "word", "count").join(dates, "text_id")
    daily = dated.groupBy("date", "language", "type", "word").agg(
        F.sum(F.col("count") * F.col("copies")).alias("count")
    )
    return daily.where(F.col("count") >= min_count)
