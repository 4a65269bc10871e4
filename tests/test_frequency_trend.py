import datetime

import pytest

import wordloom as wl

from .conftest import rows

DAY = datetime.date(2020, 3, 18)


def past(days):
    return DAY - datetime.timedelta(days=days)


def freq(spark, *data):
    """(word, days ago, count[, language, type])"""
    full = [(past(d), *(rest or ("DE", "PROPN"))[:2], w, n) for w, d, n, *rest in data]
    return spark.createDataFrame(full, "date date, language string, type string, word string, count long")


def test_word_frequency(spark):
    df = spark.createDataFrame(
        [
            (1, "DE", "PROPN", "a", "2"),
            (2, "DE", "PROPN", "a", "3"),
            (2, "DE", "NOUN", "a", "1"),
            (2, "FR", "PROPN", "a", "1"),
            (3, "DE", "PROPN", None, "1"),
        ],
        "text_id long, language string, type string, word string, count string",
    )
    assert rows(wl.word_frequency(df, ["PROPN"], ["DE"])) == [("DE", "PROPN", "a", 5)]
    assert wl.word_frequency(df).count() == 3


def test_daily_frequency(spark):
    index = spark.createDataFrame(
        [(1, "DE", "PROPN", "a", 2), (2, "DE", "PROPN", "a", 3), (3, "DE", "NOUN", "b", 1), (9, "DE", "NOUN", "b", 1)],
        "HASH_TEXT long, LANGUAGE string, TYPE string, WORD string, COUNT int",
    )
    meta = spark.createDataFrame(
        [(1, DAY, "x"), (2, DAY, "x"), (3, DAY, "x"), (3, past(1), "x")],
        "text_id long, date date, language string",
    )
    assert rows(wl.daily_word_frequency(index, meta)) == [
        (past(1), "DE", "NOUN", "b", 1),
        (DAY, "DE", "NOUN", "b", 1),
        (DAY, "DE", "PROPN", "a", 5),
    ]
    assert rows(wl.daily_word_frequency(index, meta, min_count=2), "word") == [("a",)]
    assert rows(wl.daily_word_frequency(index, meta, "DE", ["NOUN"]), "word") == [("b",), ("b",)]
    assert wl.daily_word_frequency(index, meta, "FR").count() == 0
    twice = wl.daily_word_frequency(index, meta.union(meta), types=["NOUN"])
    assert rows(twice, "date", "count") == [(past(1), 2), (DAY, 2)]


def test_regression_excludes_the_edge_and_flat_lines_have_slope_zero(spark):
    df = freq(spark, ("A", 0, 6), ("A", 1, 4), ("A", 2, 2), ("A", 7, 9), ("B", 0, 5))
    got = wl.word_trend(df, periods=[2, 7], top_ratio=1.0)
    assert got.columns == [
        "date", "language", "word", "count", "rank", "trend_2", "trend_2_ic", "trend_7", "trend_7_ic",
    ]
    a, b = rows(got, *got.columns)
    assert a[:5] == (DAY, "DE", "A", 6, 1) and a[5:] == pytest.approx((2, 6, 2, 6))
    assert b[:5] == (DAY, "DE", "B", 5, 2) and b[5:] == pytest.approx((0, 5, 0, 5))


def test_rank_ties_ratio_and_min_count(spark):
    df = freq(
        spark, ("a", 0, 9), ("b", 0, 7), ("c", 0, 7), ("d", 0, 6), ("e", 0, 4), ("f", 1, 99)
    )
    got = wl.word_trend(df, periods=[7], top_ratio=0.5)
    assert [(r["word"], r["rank"]) for r in got.collect()] == [("a", 1), ("b", 2), ("c", 2)]
    got = wl.word_trend(df, periods=[7], top_ratio=0.25)
    assert [r["word"] for r in got.collect()] == ["a"]
    got = wl.word_trend(df, periods=[7], top_n=2)
    assert [r["word"] for r in got.collect()] == ["a", "b"]
    assert wl.word_trend(df, top_n=2).columns[-1] == "trend_365_ic"


def test_languages_stay_apart(spark):
    df = freq(
        spark,
        ("a", 0, 9, "DE", "PROPN"),
        ("a", 1, 5, "DE", "PROPN"),
        ("a", 0, 8, "FR", "PROPN"),
        ("a", 0, 50, "FR", "NOUN"),
    )
    got = wl.word_trend(df, periods=[7], top_ratio=1.0)
    assert [(r["language"], r["rank"], r["trend_7"]) for r in got.collect()] == [
        ("DE", 1, 4.0),
        ("FR", 2, 0.0),
    ]
    got = wl.word_trend(df, periods=[7], top_ratio=1.0, rank_by_language=True)
    assert [(r["language"], r["rank"]) for r in got.collect()] == [("DE", 1), ("FR", 1)]
    got = wl.word_trend(df, periods=[7], top_n=1, rank_by_language=True)
    assert got.count() == 2
    assert wl.word_trend(df, periods=[7], top_ratio=1.0, languages=["FR"]).count() == 1


def test_blacklist_and_merging(spark):
    wide = spark.createDataFrame(
        [("Corona", "Coronavirus Corona-*", ""), ("Kurz", "Coro*", "")],
        "keyword string, DE string, FR string",
    )
    df = freq(
        spark,
        ("Coronavirus", 0, 3),
        ("Corona-Virus", 0, 4),
        ("Coro", 0, 5),
        ("Jahr", 0, 99),
        ("Corona-Virus", 0, 6, "FR", "PROPN"),
    )
    got = wl.word_trend(df, ["Jahr"], wl.explode_wide_lexicon(wide), periods=[7], top_ratio=1.0)
    assert rows(got, "language", "word", "count") == [
        ("DE", "Corona", 7),
        ("DE", "Kurz", 5),
        ("FR", "Corona-Virus", 6),
    ]
    merged = wl.word_trend(df, merge={"WHO": ["Jahr", "Coro"]}, periods=[7], top_ratio=1.0)
    assert ("WHO", 104) in rows(merged, "word", "count")


def test_index_to_trend(spark):
    index = spark.createDataFrame(
        [(1, "DE", "PROPN", "a", 6), (2, "DE", "PROPN", "a", 4)],
        "text_id long, language string, type string, word string, count int",
    )
    meta = spark.createDataFrame([(1, DAY), (2, past(1))], "text_id long, date date")
    got = wl.index_to_trend(index, meta, periods=[7], top_ratio=1.0).first()
    assert (got["count"], round(got["trend_7"], 6), round(got["trend_7_ic"], 6)) == (6, 2.0, 6.0)
