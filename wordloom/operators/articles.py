"""Articles: check crawled JSON lines, assemble articles from parsed items."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.frames import first_per_key
from ..schemas import ARTICLE_LINE, ARTICLES, require_columns
from .docs import media_language

# Fields a crawled line must have; texts must be longer than this.
REQUIRED_FIELDS = ("website", "url", "date", "title", "index", "text")
MIN_TEXT_LENGTH = 50

_CORRUPT = "_corrupt"


def parse_article_lines(
    lines: DataFrame,
    media: Column | str,
    crawl_date: Column | Date | str,
    line_col: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Article columns plus ``line`` and ``reject_reason`` (NULL for good lines).

    Works on batch and streaming input alike; one narrow pass. Empty lines are skipped. Columns in
    ``keep`` are carried along.
    """
    require_columns(lines, [line_col], "parse_article_lines")
    media = F.lit(media) if isinstance(media, str) else media
    day = crawl_date if isinstance(crawl_date, Column) else F.lit(crawl_date)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ARTICLE_LINE.fields)
    parsed = F.from_json(
        F.col(line_col),
        f"{fields}, {_CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )
    rows = lines.where(F.col(line_col) != "").select(
        F.col(line_col).alias("line"),
        media.alias("media"),
        day.cast("date").alias("date"),
        parsed.alias("a"),
        *keep,
    )
    gaps = F.filter(
        F.array(*[F.when(F.col(f"a.{n}").isNull(), F.lit(n)) for n in REQUIRED_FIELDS]),
        lambda name: name.isNotNull(),
    )
    reason = F.when(
        F.col("a").isNull() | F.col(f"a.{_CORRUPT}").isNotNull(), F.lit("malformed JSON")
    ).when(F.size(gaps) > 0, F.concat(F.lit("missing "), F.array_join(gaps, ", ")))
    text = F.translate("a.text", "\n", " ")
    return rows.select(
        "media",
        "date",
        tx.article_id(text).alias("text_id"),
        F.col("a.title").alias("title"),
        F.col("a.rubrics").alias("rubric"),
        F.col("a.url").alias("url"),
        F.col("a.paywall").alias("paywall"),
        F.length(text).cast("bigint").alias("num_characters"),
        text.alias("text"),
        F.col("a.index").alias("index"),
        "line",
        reason.alias("reject_reason"),
        *keep,
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """Rejected lines with the reason."""
    return parsed.where(F.col("reject_reason").isNotNull()).select("media", "reject_reason", "line")


def ingest_articles(
    lines: DataFrame,
    media: Column | str,
    crawl_date: Column | Date | str,
    line_col: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """Crawled JSON lines as (articles, rejects).

    Newlines in the text become blanks, the id is a stable hash of the text, and the first article
    (by index) per id stays.
    """
    parsed = parse_article_lines(lines, media, crawl_date, line_col)
    good = parsed.where(F.col("reject_reason").isNull()).drop("line", "reject_reason")
    articles = first_per_key(good, ["text_id"], ["index", "media", "url"])
    return articles.select(ARTICLES.names), rejected(parsed)


def assemble_articles(items: DataFrame, crawl_date: Column | Date | str) -> DataFrame:
    """Parsed items as article lines.

    Kept are items whose first text part has a word character and whose joined text is longer than
    50 characters. Adds the JSON form in ``line``.
    """
    require_columns(items, ["url", "title", "text", "website", "index"], "assemble_articles")
    day = crawl_date if isinstance(crawl_date, Column) else F.lit(crawl_date)
    optional = {
        name: F.col(name) if name in items.columns else F.lit(None).cast(kind)
        for name, kind in {"rubrics": "string", "paywall": "boolean"}.items()
    }
    first = F.get("text", F.lit(0))
    rows = items.where(F.length(tx.word_characters(first)) > 0).select(
        "website",
        day.cast("date").cast("string").alias("date"),
        F.col("index").cast("bigint").alias("index"),
        "url",
        optional["rubrics"].alias("rubrics"),
        optional["paywall"].alias("paywall"),
        F.coalesce(tx.strip_space(F.get("title", F.lit(0))), F.lit("")).alias("title"),
        tx.strip_space(F.array_join("text", " ")).alias("text"),
    )
    rows = rows.where(F.length("text") > MIN_TEXT_LENGTH)
    return rows.withColumn("line", F.to_json(F.struct(*ARTICLE_LINE.names)))


def stored_articles(files: DataFrame) -> DataFrame:
    """Records of stored article files (old or new names) as articles with their length."""
    pick = {
        "text_id": F.coalesce("text_id", "hash_text"),
        "rubric": F.coalesce("rubric", "rubrics"),
        "num_characters": F.length("text").cast("bigint"),
        "date": F.to_date("date"),
    }
    return files.select(*[pick.get(n, F.col(n)).alias(n) for n in ARTICLES.names])


def article_metadata(articles: DataFrame, language: Column) -> DataFrame:
    """Metadata rows of articles (everything but the text, with the language)."""
    return articles.select(
        "text_id",
        "date",
        "media",
        language.alias("language"),
        "url",
        "rubric",
        "title",
        "num_characters",
        "paywall",
    )


def crawl_summary(articles: DataFrame, languages: dict[str, str] | None = None) -> DataFrame:
    """Per medium and day: language (``unknown`` for unknown media), month name, article count."""
    language = media_language(F.col("media"), languages, default="unknown")
    return (
        articles.groupBy("media", "date")
        .agg(F.count(F.lit(1)).alias("num_articles"))
        .select(
            "media",
            "date",
            language.alias("language"),
            F.date_format("date", "MMMM").alias("month"),
            "num_articles",
        )
    )
