import datetime

import pytest

import wordloom as wl

from .conftest import rows

INDEX = "text_id long, language string, type string, word string, count int"


def topics(spark, *data):
    return spark.createDataFrame(list(data), "TOPIC string, LANGUAGE string, KEYWORD_1 string, KEYWORD_2 string, KEYWORD_10 string")


def test_keywords_skip_empty_ones(spark):
    df = topics(spark, ("t", "DE", "a", "", None), ("u", "DE", "c", "a", "b"))
    assert rows(wl.topic_keywords(df)) == [("t", "a"), ("u", "a"), ("u", "b"), ("u", "c")]


def test_hits_and_index(spark):
    df = topics(spark, ("t", "DE", "a", "b", "c"), ("u", "DE", "a", "", ""))
    index = spark.createDataFrame(
        [
            (1, "DE", "PROPN", "a", 9),
            (1, "DE", "PROPN", "b", 1),
            (2, "FR", "PROPN", "a", 1),
            (2, "FR", "ORG", "a", 1),
            (3, "DE", "PROPN", "x", 1),
        ],
        INDEX,
    )
    hits = wl.topic_hits(df, index)
    assert rows(hits, "text_id", "type", "word", "topic") == [
        (1, "PROPN", "a", "t"),
        (1, "PROPN", "a", "u"),
        (1, "PROPN", "b", "t"),
        (2, "ORG", "a", "t"),
        (2, "ORG", "a", "u"),
        (2, "PROPN", "a", "t"),
        (2, "PROPN", "a", "u"),
    ]
    assert rows(wl.index_topics(hits, df, 1)) == [
        (1, "t", 2, 2), (1, "u", 1, 0), (2, "t", 2, 2), (2, "u", 2, 0),
    ]
    found = wl.index_topics(hits, df, 1, distinct_words=True)
    assert rows(found.where("topic = 't'")) == [(1, "t", 2, 2)]


@pytest.mark.parametrize("tolerance, least", [(1, 9), (2, 8), (0.2, 8), (0, 10)])
def test_thresholds(spark, tolerance, least):
    names = ", ".join(f"keyword_{i} string" for i in range(1, 11))
    df = spark.createDataFrame([("t", *"abcdefghij")], f"topic string, {names}")
    hits = spark.createDataFrame(
        [(doc, w, "t") for doc in range(1, 11) for w in "abcdefghij"[:doc]],
        "text_id long, word string, topic string",
    )
    got = rows(wl.index_topics(hits, df, tolerance))
    assert [r[0] for r in got] == list(range(least, 11)) and got[0][3] == least


def test_topics_by_lda(spark):
    groups = {"DE": ["Wald Baum", "Blatt", "Ast"], "FR": ["mer", "bateau", "port"]}
    data = [
        (n, language, "PROPN", word, 1)
        for language, words in groups.items()
        for n in range(20)
        for word in words
    ]
    index = spark.createDataFrame(data + [(1, "DE", "NOUN", "Nie", 1)], INDEX)
    day = datetime.date(2020, 3, 18)
    got = wl.identify_topics(index, 2, 3, run_date=day, max_iter=2)
    assert got.columns[:7] == ["topic", "language", "type", "date", "expiry_date", "attribute", "keyword_1"]
    found = got.collect()
    assert sorted(r["topic"] for r in found) == [
        "2020-03-18-DE-0", "2020-03-18-DE-1", "2020-03-18-FR-0", "2020-03-18-FR-1",
    ]
    for row in found:
        words = {row[f"keyword_{i}"] for i in (1, 2, 3)}
        assert len(words) == 3
        assert words <= ({"Wald", "Baum", "Blatt", "Ast"} if row["language"] == "DE" else set(groups["FR"]))
        assert row["type"] == "ALGO" and row["date"] == day
    assert wl.identify_topics(index.limit(0), 2, 3).count() == 0


def test_words_of_one_feature_are_told_apart_by_count(spark):
    """Two features for all words: a topic's keywords are the most frequent words of each."""
    from wordloom.operators import topics

    counts = {w: n for n, w in enumerate(["a", "b", "c", "d", "e", "f", "g", "h"], 3)}
    data = [(doc, "DE", "PROPN", w, 1) for w, n in counts.items() for doc in range(n)] + [(1, "FR", "PROPN", "z z", 1)]
    df = spark.createDataFrame(data, INDEX)
    hashed = {(r["language"], r["word"]): (r["feature"], r["n"]) for r in topics.hashed_words(df, 2).collect()}
    assert {w: hashed["DE", w][1] for w in counts} == counts and hashed["FR", "z"][1] == 2
    best = {}
    for (language, word), (feature, n) in hashed.items():
        best[language, feature] = min(best.get((language, feature), (0, "")), (-n, word))
    names = {(r["language"], r["feature"]): r["word"] for r in topics.feature_names(topics.hashed_words(df, 2)).collect()}
    assert names == {k: w for k, (_, w) in best.items()}
    found = wl.identify_topics(df, 2, 3, languages=["DE"], max_iter=1, features=2, run_date=datetime.date(2020, 3, 18))
    for row in found.collect():
        held = [row[f"keyword_{i}"] for i in (1, 2, 3)]
        assert set(held) - {None} == {w for (code, _), w in names.items() if code == "DE"}


def test_topic_ids(spark):
    data = [(n, "DE", "PROPN", w, 1) for n in range(6) for w in "abc"]
    found = wl.identify_topics(spark.createDataFrame(data, INDEX), 2, 2, run_date=datetime.date(2020, 3, 18), max_iter=1)
    assert sorted(r["topic"] for r in found.collect()) == ["2020-03-18-DE-0", "2020-03-18-DE-1"]
