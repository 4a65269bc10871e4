"""Logical table schemas, one StructType per table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


ARTICLES = _struct(
    ("media", StringType()),
    ("date", DateType()),
    ("text_id", LongType()),
    ("title", StringType()),
    ("rubric", StringType()),
    ("url", StringType()),
    ("paywall", BooleanType()),
    ("num_characters", LongType()),
    ("text", StringType()),
)

DOC_METADATA = _struct(
    ("text_id", LongType()),
    ("date", DateType()),
    ("media", StringType()),
    ("language", StringType()),
    ("url", StringType()),
    ("rubric", StringType()),
    ("title", StringType()),
    ("num_characters", LongType()),
    ("paywall", BooleanType()),
)

DOCS = _struct(("text_id", LongType()), ("language", StringType()), ("text", StringType()))

TEXT_WORDS = _struct(
    ("text_id", LongType()),
    ("language", StringType()),
    ("type", StringType()),
    ("word", StringType()),
    ("count", IntegerType()),
)

WORD_INDEX = TEXT_WORDS

WORD_FREQUENCY = _struct(
    ("date", DateType()),
    ("language", StringType()),
    ("type", StringType()),
    ("word", StringType()),
    ("count", LongType()),
)

SENTIMENTS = _struct(
    ("text_id", LongType()), ("polarity", DoubleType()), ("subjectivity", DoubleType())
)

TEXT_SENTIMENTS = _struct(("text_id", LongType()), ("sentiment", DoubleType()))

SENTIMENT_LIST = _struct(("word", StringType()), ("value", DoubleType()))

SENTIMENT_SOURCE = _struct(
    ("language", StringType()), ("word", StringType()), ("value", DoubleType())
)

LEXICON = _struct(
    ("language", StringType()),
    ("word", StringType()),
    ("mapping", StringType()),
    ("category", StringType()),
)

BLACKLIST = _struct(("word", StringType()))

TOPIC_INDEX = _struct(
    ("text_id", LongType()),
    ("topic", StringType()),
    ("count", LongType()),
    ("min_num", LongType()),
)

TOPIC_HEAD = _struct(
    ("topic", StringType()),
    ("language", StringType()),
    ("type", StringType()),
    ("date", DateType()),
    ("expiry_date", DateType()),
    ("attribute", StringType()),
)

# One crawled article as a JSON line.
ARTICLE_LINE = _struct(
    ("website", StringType()),
    ("date", StringType()),
    ("index", LongType()),
    ("url", StringType()),
    ("rubrics", StringType()),
    ("paywall", BooleanType()),
    ("title", StringType()),
    ("text", StringType()),
)

# One parsed page before assembly into an article.
ITEM = _struct(
    ("url", StringType()),
    ("title", ArrayType(StringType())),
    ("text", ArrayType(StringType())),
    ("website", StringType()),
    ("index", LongType()),
    ("comments", StringType()),
    ("rubrics", StringType()),
    ("paywall", BooleanType()),
)

# One stored article file record (older files say hash_text and rubrics).
ARTICLE_FILE = _struct(
    ("media", StringType()),
    ("date", StringType()),
    ("hash_text", LongType()),
    ("text_id", LongType()),
    ("title", StringType()),
    ("rubrics", StringType()),
    ("rubric", StringType()),
    ("url", StringType()),
    ("paywall", BooleanType()),
    ("text", StringType()),
)

# Column widths of the stored tables.
WIDTHS = {
    "doc_metadata": {"media": 50, "language": 2, "url": 255, "rubric": 50, "title": 255},
    "text_words": {"language": 2, "type": 15, "word": 80},
}

# Key columns of the stored tables.
KEYS = {
    "doc_metadata": ["text_id", "date"],
    "text_words": ["text_id", "type", "word"],
    "sentiments": ["text_id"],
    "text_sentiments": ["text_id"],
}


def topics_schema(num_keywords: int) -> StructType:
    """Wide topic table: fixed head plus keyword_1..keyword_n."""
    tail = [StructField(f"keyword_{i}", StringType(), True) for i in range(1, num_keywords + 1)]
    return StructType([*TOPIC_HEAD.fields, *tail])


def require_columns(df: DataFrame, names: Iterable[str], operator: str) -> None:
    """Fail at plan-building time when an input lacks a column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{operator}: missing column(s) {missing}; got {df.columns}")


def fit_widths(df: DataFrame, table: str) -> DataFrame:
    """Cut string columns to the stored width of ``table``; counts of keys that become equal add up."""
    cuts = {c: F.substring(c, 1, n) for c, n in WIDTHS.get(table, {}).items() if c in df.columns}
    df = df.withColumns(cuts) if cuts else df
    if "count" not in df.columns:
        return df
    keys = [c for c in df.columns if c != "count"]
    return df.groupBy(*keys).agg(F.sum("count").alias("count")).select(*df.columns)


def values_to_cut(df: DataFrame, table: str) -> DataFrame:
    """One row (column, n): how many values ``fit_widths`` would cut, for each column with a width."""
    widths = {c: n for c, n in WIDTHS.get(table, {}).items() if c in df.columns}
    totals = [F.count_if(F.length(c) > n).alias(c) for c, n in widths.items()]
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in widths]
    return df.agg(*totals).select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.n")


def canonical_names(df: DataFrame) -> DataFrame:
    """Lower-case column names and map legacy names to current ones."""
    legacy = {"hash_text": "text_id", "rubrics": "rubric"}
    renames = {}
    for name in df.columns:
        target = legacy.get(name.lower(), name.lower())
        if target != name:
            renames[name] = target
    return df.withColumnsRenamed(renames) if renames else df
