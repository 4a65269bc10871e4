"""Readers. Every reader takes or has an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.articles import stored_articles
from ..schemas import (
    ARTICLE_FILE,
    LEXICON,
    SENTIMENT_LIST,
    SENTIMENT_SOURCE,
    WORD_FREQUENCY,
    canonical_names,
    topics_schema,
)
from .json_arrays import json_array_records, parse_records


def read_article_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines as raw text (column ``value``), for ``ingest_articles``."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").load(path)


def read_article_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A directory of files, each one JSON array of articles: (articles, rejects).

    Rejects are the files that are no JSON array of objects or not UTF-8: file, reject_reason.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    records = F.from_json(text, ArrayType(ARTICLE_FILE), {"mode": "PERMISSIVE"})
    parsed = files.select("file", text.alias("text"), records.alias("records"))
    rejects = parsed.where(F.col("records").isNull()).select(
        "file",
        F.when(F.col("text").isNull(), F.lit("not UTF-8")).otherwise(F.lit("malformed JSON")).alias("reject_reason"),
    )
    return stored_articles(parsed.select(F.inline("records"))), rejects


def read_article_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A directory of JSON arrays of articles, each of any size: (articles, rejects).

    A large array is read by many tasks. Rejects are single records: file, number, reject_reason, record.
    """
    rows, rejects = parse_records(json_array_records(spark, path), ARTICLE_FILE)
    return stored_articles(rows), rejects


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    header: bool = True,
    sep: str = ",",
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """CSV with a schema; ``columns`` and ``limit`` take a part of it."""
    df = spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)
    if columns:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """One word per line (first CSV field), no header."""
    lines = spark.read.schema("word string").option("header", False).csv(path)
    return lines.where(F.col("word").isNotNull())


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon CSV (language, word, mapping, category) with header."""
    return read_csv(spark, path, LEXICON)


def read_wide_lexicon(spark: SparkSession, path: str, languages: Sequence[str]) -> DataFrame:
    """Wide lexicon CSV: keyword, then one column per language; for ``explode_wide_lexicon``."""
    names = ["keyword", *languages]
    return read_csv(
        spark, path, StructType([StructField(n, StringType(), True) for n in names])
    )


def read_sentiment_list(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment list CSV (word, value) with header."""
    return read_csv(spark, path, SENTIMENT_LIST)


def read_sentiment_source(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Source list CSV (language name, word, value)."""
    return read_csv(spark, path, SENTIMENT_SOURCE, header=header)


def read_word_frequency(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Daily word frequencies CSV; without header the names are supplied."""
    return read_csv(spark, path, WORD_FREQUENCY, header=header)


def read_topics(spark: SparkSession, path: str, num_keywords: int = 10) -> DataFrame:
    """Wide topic CSV; the header line is skipped and columns are taken by position."""
    return read_csv(spark, path, topics_schema(num_keywords))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table with canonical column names."""
    return canonical_names(spark.table(name))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A database table or subquery; give a numeric partition column to read it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.options(**(properties or {}))
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
        )
    return canonical_names(reader.load())
