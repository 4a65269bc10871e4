"""Daily frequencies kept up to date, delivery by delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.frequency import daily_word_frequency
from ..schemas import canonical_names
from ..sources.writers import replace_partitions


def update_daily_frequency(index: DataFrame, metadata: DataFrame, delivered: DataFrame, path: str) -> None:
    """Bring the stored daily frequencies up to date for the days of newly delivered documents.

    ``index`` and ``metadata`` hold everything so far, ``delivered`` the new documents (text_id). The days that
    these fall on are counted anew from all their documents and replaced; other days are neither read nor
    written. So a delivery may come again, and a late one may add to a day that is already stored.
    """
    metadata = canonical_names(metadata)
    dated = metadata.where(F.col("text_id").isNotNull() & F.col("date").isNotNull()).select("text_id", "date")
    days = dated.join(delivered.select("text_id").distinct(), "text_id", "left_semi").select("date").distinct()
    touched = dated.join(days, "date", "left_semi")
    replace_partitions(daily_word_frequency(index, touched), path, "word_frequency")
