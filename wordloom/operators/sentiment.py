"""Sentiment of documents from word lists, and preparation of the lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.frames import first_per_key
from ..functions.joins import fits_broadcast, lookup_join
from ..functions.masks import one_of
from ..functions.text import round_half_even, strip_space, tokens
from ..schemas import require_columns

# Language names of the source list and their codes.
LANGUAGE_CODES = {
    "spanish": "ES",
    "portuguese": "PT",
    "english": "EN",
    "french": "FR",
    "german": "DE",
}

# Sums of list values are exact in decimals, so results do not depend on the order of rows.
_EXACT = "decimal(28,8)"
_SCORE = "decimal(20,8)"  # a score times the number of its words stays exact as well

Scorer = Callable[[pd.Series, pd.Series], pd.DataFrame]


def wordlist_sentiment(
    words: DataFrame,
    sentiment_list: DataFrame,
    languages: Sequence[str] = ("DE",),
    pos: Sequence[str] = ("NOUN", "VERB", "ADJ"),
) -> DataFrame:
    """Mean list value over the set of lower-cased lemmas of each document.

    ``words`` is the output of ``annotate_tokens`` (use ``keep_empty=True`` so that every document
    appears). Documents without a hit get NULL. A list word that occurs on several list rows
    counts once per row.
    """
    require_columns(words, ["text_id", "language", "lemma", "pos"], "wordlist_sentiment")
    per_word = sentiment_list.where(F.col("word").isNotNull() & F.col("value").isNotNull())
    per_word = per_word.groupBy("word").agg(
        F.sum(F.col("value").cast(_EXACT)).alias("total"), F.count("value").alias("entries")
    )
    lemma = F.when(one_of("pos", pos), F.lower("lemma")).alias("word")
    rows = words.where(one_of("language", languages)).select("text_id", lemma)
    small = fits_broadcast(sentiment_list.select("word", "value"))
    hits = lookup_join(rows, per_word, ["word"], "left", spread_by=["text_id"], small=small)
    # All misses of a document fall into one NULL group, before the shuffle.
    hit_word = F.when(F.col("total").isNotNull(), F.col("word")).alias("word")
    distinct = hits.groupBy("text_id", hit_word).agg(
        F.max("total").alias("total"), F.max("entries").alias("entries")
    )
    return distinct.groupBy("text_id").agg(
        (F.sum("total").cast("double") / F.sum("entries")).alias("sentiment")
    )


def score_sentiment(
    docs: DataFrame,
    scored_lexicon: DataFrame | None = None,
    scorer: Scorer | None = None,
    analyzer_languages: Sequence[str] = ("DE", "FR"),
    fallback_language: str = "EN",
) -> DataFrame:
    """Polarity and subjectivity per text, rounded to two digits.

    ``scored_lexicon(language, word, polarity, subjectivity)`` gives the mean over all hits of
    lower-cased words; a text without hits scores 0. Texts in a language outside
    ``analyzer_languages`` are scored with ``fallback_language``. A missing text scores NULL.
    ``scorer(texts, languages)`` plugs in a model: it gets the texts that are not missing and
    returns both columns with the index of the texts.
    """
    require_columns(docs, ["text_id", "language", "text"], "score_sentiment")
    language = F.when(one_of("language", analyzer_languages), F.col("language")).otherwise(
        F.lit(fallback_language)
    )
    if scorer is not None:
        # Set by hand: pandas_udf reads annotations, which are strings in this module.
        def run(texts, codes):
            given = texts.notna()
            names = ["polarity", "subjectivity"]
            if not given.any():
                return pd.DataFrame(float("nan"), index=texts.index, columns=names)
            return scorer(texts[given], codes[given])[names].reindex(texts.index)

        run.__annotations__ = {"texts": pd.Series, "codes": pd.Series, "return": pd.DataFrame}
        score = F.pandas_udf(run, "polarity double, subjectivity double")
        scored = docs.select("text_id", score(F.col("text"), language).alias("s"))
        return scored.select(
            "text_id",
            *[
                round_half_even(F.nanvl(f"s.{name}", F.lit(None).cast("double")), 2).alias(name)
                for name in ("polarity", "subjectivity")
            ],
        )
    if scored_lexicon is None:
        raise ValueError("score_sentiment: pass scored_lexicon or scorer")
    table = scored_lexicon.groupBy("language", "word").agg(
        F.max(F.col("polarity").cast(_SCORE)).alias("polarity"),
        F.max(F.col("subjectivity").cast(_SCORE)).alias("subjectivity"),
    )
    missing = F.col("text").isNull().alias("missing")
    rows = docs.select(
        "text_id",
        language.alias("language"),
        missing,
        F.explode_outer(tokens(F.lower("text"))).alias("word"),
    )
    # Words are counted per text first, so that each meets the lexicon once.
    times = F.count(F.lit(1)).cast("decimal(10,0)")
    rows = rows.groupBy("text_id", "language", "missing", "word").agg(times.alias("times"))
    small = fits_broadcast(scored_lexicon)
    on = ["language", "word"]
    hits = lookup_join(rows, table, on, "left", spread_by=["text_id"], small=small)
    means = {
        name: round_half_even(
            F.sum(F.col(name) * F.col("times")).cast("double")
            / F.nullif(F.sum(F.when(F.col(name).isNotNull(), F.col("times"))).cast("double"), F.lit(0.0)),
            2,
        )
        for name in ("polarity", "subjectivity")
    }
    gone = F.bool_and("missing")
    return hits.groupBy("text_id").agg(
        *[
            F.when(~gone, F.coalesce(mean, F.lit(0.0))).alias(name)
            for name, mean in means.items()
        ]
    )


def prepare_sentiment_source(
    df: DataFrame,
    languages: Sequence[str] | None = ("DE",),
    codes: dict[str, str] | None = None,
) -> DataFrame:
    """Keep known languages, map names to codes, trim words, keep ``languages``."""
    require_columns(df, ["language", "word", "value"], "prepare_sentiment_source")
    pairs = LANGUAGE_CODES if codes is None else codes
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    code = F.try_element_at(F.create_map(*entries), F.col("language"))
    rows = df.where(F.col("language").isin(list(pairs))).select(
        code.alias("language"), strip_space(F.col("word")).alias("word"), "value"
    )
    return rows.where(one_of("language", languages))


def rescale_sentiment_list(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Bring values from 0..9 to -1..1 with two digits, one row per word."""
    require_columns(df, ["word", "value"], "rescale_sentiment_list")
    scaled = df.withColumn("value", round_half_even(F.col("value") / F.lit(4.5) - F.lit(1.0), 2))
    return first_per_key(scaled, ["word"], order_by)


def sentiment_list_range(df: DataFrame) -> DataFrame:
    """Number of words and the range of values."""
    return df.agg(
        F.count(F.lit(1)).alias("num_words"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
