"""Documents: select, prepare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.frames import count_rows, deal_texts, first_per_key
from ..functions.regex import replace_each
from ..schemas import require_columns

# Repairs of missing blanks after punctuation, in order.
DEFAULT_REPLACEMENTS = {
    r"([\:,\.?!\)])([A-Z])": r"\1 \2",
    r"(,)([a-z])": r"\1 \2",
    r"(\"\.)([A-Z])": r"\1 \2",
    r"(\.)(\"[A-Z])": r"\1 \2",
}

# The same repairs for capitals and small letters of every alphabet.
UNICODE_REPLACEMENTS = {
    r"([\:,\.?!\)])(\p{Lu})": r"\1 \2",
    r"(,)(\p{Ll})": r"\1 \2",
    r"(\"\.)(\p{Lu})": r"\1 \2",
    r"(\.)(\"\p{Lu})": r"\1 \2",
}

# Language of the crawled media.
MEDIA_LANGUAGES = {
    "Lefigaro": "FR",
    "Lemonde": "FR",
    "Elpais": "ES",
    "Elmundo": "ES",
    "Spiegel": "DE",
    "Sueddeutsche": "DE",
    "FAZ": "DE",
}


def select_docs(
    source: DataFrame, columns: Sequence[str], where: str | Column | None = None
) -> DataFrame:
    """Project SQL expressions from a table, with an optional row condition."""
    rows = source if where is None else source.where(where)
    return rows.selectExpr(*columns)


def media_language(
    media: Column, languages: dict[str, str] | None = None, default: str = "DE"
) -> Column:
    """Language of a medium, ``default`` for unknown media."""
    pairs = MEDIA_LANGUAGES if languages is None else languages
    if not pairs:
        return F.lit(default)
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), media), F.lit(default))


def undecodable_docs(df: DataFrame, text_col: str = "text", id_col: str = "text_id") -> DataFrame:
    """Documents whose bytes are not UTF-8: text_id, reject_reason, text (the bytes).

    ``prepare_docs`` keeps them with a NULL text.
    """
    bad = F.col(text_col).isNotNull() & tx.decode_utf8(F.col(text_col)).isNull()
    return df.where(bad).select(
        F.col(id_col).alias("text_id"), F.lit("not UTF-8").alias("reject_reason"), F.col(text_col).alias("text")
    )


def prepare_docs(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "text_id",
    language_col: str = "language",
    default_language: str = "DE",
    media_languages: dict[str, str] | None = None,
    strip_html: bool = False,
    replacements: dict[str, str] | None = None,
    seen: DataFrame | None = None,
    order_by: Sequence[str] | None = None,
    dedupe: bool = True,
    observation=None,
) -> DataFrame:
    """Bring raw documents into the form (text_id, language, text).

    The language comes from ``media_languages`` by medium when given, else from ``language_col``;
    only a missing language is replaced by the default. One row per id is kept, the first by
    ``order_by`` (then by all columns); ids in ``seen`` are dropped. Tags are removed on request
    and ``replacements`` run in order (an empty dict runs none).

    One shuffle by id carries the texts, into as many partitions as their measured bytes ask for. Later
    per-document grouping reuses that partitioning, so what a task counts does not grow with the input.
    """
    require_columns(df, [text_col, id_col], "prepare_docs")
    if media_languages is not None:
        require_columns(df, ["media"], "prepare_docs")
        language = media_language(F.col("media"), media_languages, default_language)
    elif language_col in df.columns:
        language = F.coalesce(F.col(language_col), F.lit(default_language))
    else:
        language = F.lit(default_language)

    text = F.col(text_col)
    if df.schema[text_col].dataType.typeName() == "binary":
        text = tx.decode_utf8(text)

    order = [c for c in order_by or [] if c not in (id_col, text_col)]
    docs = df.select(
        F.col(id_col).alias("text_id"),
        language.alias("language"),
        text.alias("text"),
        *[F.col(c).alias(f"__order_{i}") for i, c in enumerate(order)],
    )
    if dedupe:
        by = [f"__order_{i}" for i in range(len(order))]
        docs = first_per_key(deal_texts(docs, "text_id", "text", by), ["text_id"], by)
    if seen is not None:
        # Distinct first: an id stored very often must not pile up in the join.
        ids = seen.select(F.col(seen.columns[0]).alias("text_id")).distinct()
        docs = docs.join(ids, "text_id", "left_anti")

    cleaned = F.col("text")
    if strip_html:
        cleaned = tx.strip_tags(cleaned)
    cleaned = replace_each(cleaned, DEFAULT_REPLACEMENTS if replacements is None else replacements)
    docs = docs.select("text_id", "language", cleaned.alias("text"))
    return count_rows(docs, observation)
