"""Composed flows over documents."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from ..operators.docs import prepare_docs
from ..operators.frequency import daily_word_frequency
from ..operators.trend import word_trend
from ..operators.words import extract_words


def documents_to_words(
    raw: DataFrame,
    prepare: dict | None = None,
    extract: dict | None = None,
) -> DataFrame:
    """Raw documents to counted words; one shuffle by id serves dedupe and counting."""
    return extract_words(prepare_docs(raw, **(prepare or {})), **(extract or {}))


def index_to_trend(
    index: DataFrame,
    metadata: DataFrame,
    blacklist: DataFrame | Iterable[str] | None = None,
    lexicon: DataFrame | None = None,
    type: str = "PROPN",
    periods: Sequence[int] | None = None,
    **trend,
) -> DataFrame:
    """Word index and metadata to word trends."""
    freq = daily_word_frequency(index, metadata, types=[type])
    return word_trend(freq, blacklist, lexicon, type=type, periods=periods, **trend)
