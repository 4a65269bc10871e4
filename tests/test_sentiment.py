import pandas as pd
import pytest

import wordloom as wl
from wordloom.functions.text import round_half_even
from pyspark.sql import functions as F

from .conftest import rows


def tokens(spark, *data):
    return spark.createDataFrame(
        list(data), "text_id long, language string, surface string, lemma string, pos string"
    )


def test_mean_over_the_set_of_lemmas(spark):
    words = tokens(
        spark,
        (1, "DE", "x", "Gut", "ADJ"),
        (1, "DE", "x", "gut", "ADJ"),
        (1, "DE", "x", "Krieg", "NOUN"),
        (1, "DE", "x", "gut", "PROPN"),
        (2, "DE", "x", "nichts", "NOUN"),
        (3, "FR", "x", "gut", "ADJ"),
        (4, "DE", None, None, None),
    )
    listed = spark.createDataFrame(
        [("gut", 0.5), ("krieg", -0.8), ("Krieg", 9.0), ("x", None)], "word string, value double"
    )
    assert rows(wl.wordlist_sentiment(words, listed)) == [(1, -0.15), (2, None), (4, None)]
    twice = listed.union(spark.createDataFrame([("gut", 0.2)], listed.schema))
    assert rows(wl.wordlist_sentiment(words, twice))[0][1] == pytest.approx(-0.1 / 3)


def scored(spark):
    return spark.createDataFrame(
        [
            ("DE", "gut", 0.7, 0.5),
            ("DE", "schlecht", -0.45, 0.25),
            ("EN", "good", 0.7, 0.6),
            ("FR", "bon", 0.6, 0.4),
        ],
        "language string, word string, polarity double, subjectivity double",
    )


def test_scores_by_lexicon(spark):
    docs = spark.createDataFrame(
        [
            (1, "DE", "Gut gut schlecht"),
            (2, "ES", "good bon"),
            (3, "DE", "good"),
            (4, "DE", None),
            (5, "FR", ""),
        ],
        "text_id long, language string, text string",
    )
    assert rows(wl.score_sentiment(docs, scored(spark))) == [
        (1, 0.32, 0.42),
        (2, 0.7, 0.6),
        (3, 0.0, 0.0),
        (4, None, None),
        (5, 0.0, 0.0),
    ]


def test_scores_by_plugged_model(spark):
    def scorer(texts, languages):
        return pd.DataFrame({"polarity": texts.str.len() / 8, "subjectivity": (languages == "EN") * 1.0})

    docs = spark.createDataFrame(
        [(1, "DE", "a"), (2, "ES", "aaa"), (3, "DE", None)], "text_id long, language string, text string"
    )
    assert rows(wl.score_sentiment(docs, scorer=scorer)) == [(1, 0.12, 0.0), (2, 0.38, 1.0), (3, None, None)]
    with pytest.raises(ValueError):
        wl.score_sentiment(docs)


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.375,), (-0.125,)], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()]
    assert got == [0.12, 2.68, 0.38, -0.12]


def test_source_list(spark):
    df = spark.createDataFrame(
        [("german", " gut\t", 7.0), ("dutch", "goed", 7.0), ("french", "bon", 7.0)],
        "language string, word string, value double",
    )
    assert rows(wl.prepare_sentiment_source(df)) == [("DE", "gut", 7.0)]
    assert wl.prepare_sentiment_source(df, None).count() == 2


def test_rescaling(spark):
    df = spark.createDataFrame(
        [("a", 9.0), ("b", 0.0), ("c", 4.5), ("d", 6.3), ("a", 1.0)], "word string, value double"
    ).withColumn("line", F.monotonically_increasing_id())
    got = wl.rescale_sentiment_list(df, ["line"])
    assert rows(got, "word", "value") == [("a", 1.0), ("b", -1.0), ("c", 0.0), ("d", 0.4)]
    assert rows(wl.sentiment_list_range(got)) == [(4, -1.0, 1.0)]
