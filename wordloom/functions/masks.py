"""Row masks that stay NULL-safe."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def one_of(column: str, values: Sequence[str] | None) -> Column:
    """``column IN values``; an empty list means no restriction. Never NULL."""
    if isinstance(values, str):
        raise TypeError(f"{column}: pass a list of values, not the string {values!r}")
    if not values:
        return F.lit(True)
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def type_language_mask(
    word_types: Sequence[str] | None, languages: Sequence[str] | None
) -> Column:
    """Rows an operator applies to."""
    return one_of("type", word_types) & one_of("language", languages)


def keys_present(columns: Sequence[str]) -> Column:
    """All key columns set; rows with a missing key take no part in a grouping."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def sum_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total ``count`` per key; map-side partial sums absorb hot keys."""
    return df.where(keys_present(keys)).groupBy(*keys).agg(F.sum("count").alias("count"))
