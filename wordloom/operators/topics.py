"""Topics: find them, look up their words in the index, index documents by topic."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date as Date

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.joins import lookup_join
from ..functions.masks import one_of
from ..schemas import TOPIC_HEAD, canonical_names, require_columns

# Hash buckets for words in topic finding: few words share one, and k topics are k times as many numbers.
FEATURES = 1 << 18


def _keyword_columns(topics: DataFrame) -> list[str]:
    names = [c for c in topics.columns if re.fullmatch(r"keyword_\d+", c)]
    return sorted(names, key=lambda c: int(c.split("_")[1]))


def topic_keywords(topics: DataFrame) -> DataFrame:
    """Wide topics in long form: one row (topic, keyword) per non-empty keyword."""
    topics = canonical_names(topics)
    require_columns(topics, ["topic"], "topic_keywords")
    listed = F.array(*[F.col(c) for c in _keyword_columns(topics)])
    filled = F.filter(listed, lambda k: k.isNotNull() & (k != ""))
    return topics.select("topic", F.explode(filled).alias("keyword"))


def topic_hits(topics: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows whose word is a keyword, once per topic with that keyword; all topics at once."""
    index = canonical_names(index)
    require_columns(index, ["text_id", "word"], "topic_hits")
    by_word = topic_keywords(topics).select(F.col("keyword").alias("word"), "topic").distinct()
    return lookup_join(index, by_word, ["word"], "inner")


def index_topics(
    hits: DataFrame, topics: DataFrame, tolerance: float = 1, distinct_words: bool = False
) -> DataFrame:
    """Documents per topic with at least ``min_num`` keyword rows.

    ``min_num`` is the topic's number of keywords minus ``tolerance``, taken as a share of the
    keywords when below 1. A word found under two types counts twice unless ``distinct_words``.
    """
    require_columns(hits, ["text_id", "topic", "word"], "index_topics")
    num = F.count("keyword")
    slack = (F.lit(float(tolerance)) * num).cast("bigint") if tolerance < 1 else F.lit(tolerance)
    limits = topic_keywords(topics).groupBy("topic").agg(
        (num - slack).cast("bigint").alias("min_num")
    )
    if distinct_words:
        hits = hits.select("text_id", "topic", "word").distinct()
    counted = hits.groupBy("text_id", "topic").agg(F.count("word").alias("count"))
    found = lookup_join(counted, limits, ["topic"], "inner", spread_by=["text_id"])
    return found.where(F.col("count") >= F.col("min_num")).select(
        "text_id", "topic", "count", "min_num"
    )


def document_bags(
    index: DataFrame,
    languages: Sequence[str] | None = None,
    word_types: Sequence[str] | None = ("PROPN",),
) -> DataFrame:
    """Words per (text_id, language) as an array; words with blanks are split."""
    index = canonical_names(index)
    require_columns(index, ["text_id", "language", "type", "word"], "document_bags")
    rows = index.where(one_of("language", languages) & one_of("type", word_types))
    rows = rows.select(
        "text_id", "language", F.explode(tx.whitespace_tokens(F.col("word"))).alias("word")
    )
    return rows.groupBy("text_id", "language").agg(F.collect_list("word").alias("words"))


def hashed_words(index: DataFrame, features: int = FEATURES) -> DataFrame:
    """(language, feature, word, n): all words of the bags, their hash bucket and their number."""
    words = index.select("language", F.explode(tx.whitespace_tokens(F.col("word"))).alias("word"))
    counted = words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("language", feature_of(F.col("word"), features).alias("feature"), "word", "n")


def feature_of(word: Column, features: int = FEATURES) -> Column:
    """One of a fixed number of features, by a hash of the word."""
    return F.pmod(F.xxhash64(word), F.lit(features)).cast("int")


def feature_names(words: DataFrame) -> DataFrame:
    """(language, feature, word): of the words of a feature the most frequent, ties by the word.

    A sum and a maximum per word, all on the executors: words are never numbered on the driver.
    """
    order = F.struct((-F.col("n")).alias("rank"), "word")
    return words.groupBy("language", "feature").agg(F.min(order).alias("first")).select(
        "language", "feature", F.col("first.word").alias("word")
    )


def identify_topics(
    index: DataFrame,
    num_topics: int = 20,
    topic_num_words: int = 10,
    languages: Sequence[str] | None = None,
    word_types: Sequence[str] | None = ("PROPN",),
    seed: int = 0,
    run_date: Date | None = None,
    max_iter: int = 10,
    features: int = FEATURES,
) -> DataFrame:
    """Topics per language by online LDA, in the wide topic form (keyword_1..keyword_n).

    Every iteration passes over all documents. All words count (no minimum document frequency, case kept), each
    under one of ``features`` hash buckets, so what the driver holds (topics x features numbers) does not grow
    with the vocabulary. A topic's keywords are its heaviest features' words, joined back on the
    executors; where words share a feature the most frequent stands for it. The bags are settled in the
    shared folder because every iteration reads them. Results repeat for a seed and a given
    partitioning of the input; they differ from those of other LDA implementations.
    """
    from ..functions.workdir import settle

    spark = index.sparkSession
    index = canonical_names(index)
    bags = document_bags(index, languages, word_types)
    hashed = F.transform("words", lambda w: feature_of(w, features).cast("string"))
    bags = settle(bags.select("language", hashed.alias("features")), "topic-bags")
    rows = index.where(one_of("language", languages) & one_of("type", word_types))
    names = feature_names(hashed_words(rows, features))
    if not languages:
        languages = sorted(r["language"] for r in bags.select("language").distinct().collect())
    day = F.lit(run_date) if run_date else F.current_date()
    heaviest = []
    for language in languages:
        docs = bags.where(F.col("language") == language)
        # At most ``features`` numbers: those that occur.
        occur = sorted(r[0] for r in docs.select(F.explode("features")).distinct().collect())
        if not occur:
            continue
        counter = CountVectorizerModel.from_vocabulary(occur, inputCol="features", outputCol="counts")
        model = LDA(
            featuresCol="counts",
            k=num_topics,
            optimizer="online",
            seed=seed,
            maxIter=max_iter,
            subsamplingRate=1.0,
        ).fit(counter.transform(docs).select("counts"))
        heaviest += [
            (language, row["topic"], place, int(occur[term]))
            for row in model.describeTopics(topic_num_words).collect()
            for place, term in enumerate(row["termIndices"], 1)
        ]
    # The result's size: num_topics times topic_num_words per language.
    terms = spark.createDataFrame(heaviest, "language string, n int, place int, feature int")
    found = terms.join(names, ["language", "feature"], "left").groupBy("language", "n").agg(
        *[F.max(F.when(F.col("place") == i + 1, F.col("word"))).alias(f"keyword_{i + 1}") for i in range(topic_num_words)]
    )
    types = {f.name: f.dataType for f in TOPIC_HEAD.fields}
    return found.select(
        F.concat_ws("-", day.cast("string"), "language", F.col("n").cast("string")).alias("topic"),
        "language",
        F.lit("ALGO").alias("type"),
        day.alias("date"),
        F.lit(None).cast(types["expiry_date"]).alias("expiry_date"),
        F.lit(None).cast(types["attribute"]).alias("attribute"),
        *[f"keyword_{i + 1}" for i in range(topic_num_words)],
    )
