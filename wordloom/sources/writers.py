"""Writers and table definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.frames import duplicate_report
from ..functions.workdir import settings
from ..schemas import KEYS, fit_widths

# Columns a table is partitioned by: language for words, date for daily frequencies.
PARTITIONS = {"text_words": ["language"], "word_index": ["language"], "word_frequency": ["date"]}

# Files of partition values that a task keeps open, so that it need not sort its rows; beyond them it sorts the rest.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "32"}

TABLES = {
    "doc_metadata": schemas.DOC_METADATA,
    "text_words": schemas.TEXT_WORDS,
    "word_index": schemas.WORD_INDEX,
    "word_frequency": schemas.WORD_FREQUENCY,
    "sentiments": schemas.SENTIMENTS,
    "text_sentiments": schemas.TEXT_SENTIMENTS,
    "topic_index": schemas.TOPIC_INDEX,
}


def create_table(spark: SparkSession, table: str, name: str | None = None) -> None:
    """Create a catalog table with the schema of ``table`` if it does not exist."""
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[table].fields
    )
    split = PARTITIONS.get(table, [])
    by = f" PARTITIONED BY ({', '.join(split)})" if split else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name or table} ({columns}) USING parquet{by}")


def _stored_form(df: DataFrame, table: str, cut: bool) -> DataFrame:
    schema = TABLES[table]
    if cut:
        df = fit_widths(df, table)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _clustered(df: DataFrame, split: Sequence[str]) -> DataFrame:
    """Rows of one partition value near each other, a large value over several tasks and files.

    REBALANCE lets adaptive execution split a value with very many rows. A task's rows are not sorted by value
    before they are written (``OPEN_FILES``), which would hold them all.
    """
    return df.hint("rebalance", *split) if split else df


def append_table(
    df: DataFrame, table: str, name: str | None = None, cut: bool = False
) -> None:
    """Append rows to a catalog table made by ``create_table``.

    Values are stored whole; ``cut`` fits them to the widths of a database table, and
    ``values_to_cut`` says how many that changes.
    """
    rows = _stored_form(df, table, cut)
    # insertInto goes by position; partition columns come last in the table.
    target = df.sparkSession.table(name or table)
    with settings(df.sparkSession, OPEN_FILES):
        _clustered(rows, PARTITIONS.get(table, [])).select(*target.columns).write.insertInto(
            name or table
        )


def write_parquet(
    df: DataFrame, path: str, table: str, mode: str = "append", cut: bool = False
) -> None:
    """Write a table as Parquet files, partitioned as the catalog table would be."""
    split = PARTITIONS.get(table, [])
    writer = _clustered(_stored_form(df, table, cut), split).write.mode(mode)
    with settings(df.sparkSession, OPEN_FILES):
        (writer.partitionBy(*split) if split else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, table: str, cut: bool = False) -> None:
    """Replace those partitions of a Parquet table that ``df`` has rows of; all others stay as they are.

    Running it again leaves the same table, where appending would store the rows twice.
    """
    split = PARTITIONS[table]
    rows = _clustered(_stored_form(df, table, cut), split)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    with settings(df.sparkSession, OPEN_FILES):
        writer.partitionBy(*split).parquet(path)


def key_duplicates(df: DataFrame, table: str) -> DataFrame:
    """Rows that repeat the key of ``table``; Parquet tables do not enforce keys."""
    return duplicate_report(df, KEYS[table])


def write_csv(df: DataFrame, path: str, mode: str = "error", sep: str = ",") -> None:
    """CSV files with header."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; characters outside ASCII are kept as they are."""
    df.write.mode(mode).json(path)
