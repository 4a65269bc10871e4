import re

import pytest
from pyspark.sql import functions as F

import wordloom as wl
from wordloom.functions import regex as rx, workdir
from wordloom.functions.text import word_characters

TEXTS = ["Écoute 12 x", "a.b\rc", "x\n", "foo[1] & bar", "price $5", "ab-ab", "日本 x", "٣ d", "]x^", ""]
PATTERNS = [
    r"\w+", r"\W+", r"\d", r"\bx\b", r"a.b", r"b.c", r"x$", r"^x", r"[[]1", r"[&&]", r"[]^]",
    r"(?P<p>ab)-(?P=p)", r"x\Z", r"[^\w\s]", r"\$\d",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_match_as_in_python(spark, pattern):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "n int, t string")
    got = df.select("n", rx.contains(F.col("t"), pattern)).collect()
    start = df.select("n", rx.matches_start(F.col("t"), pattern)).collect()
    for (n, found), (_, at_start) in zip(got, start):
        assert found == bool(re.search(pattern, TEXTS[n])), TEXTS[n]
        assert at_start == bool(re.match(pattern, TEXTS[n])), TEXTS[n]


def test_any_of_several_patterns(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for patterns in ([r"\d", r"^x", "[[]"], [r"(x)\1", r"a.b"], [r"(?i)É"], [r"x$"], []):
        got = [r[0] for r in df.select(rx.contains_any(F.col("t"), patterns)).collect()]
        assert got == [any(re.search(p, t) for p in patterns) for t in TEXTS], patterns


@pytest.mark.parametrize(
    "pattern, replacement",
    [
        (r"(\w)(\d)", r"\2\1"),
        (r"(?P<a>b)", r"<\g<a>>"),
        (r"(b)", r"\g<1>0"),
        (r"x", r"$1"),
        (r"x", r"a\\b"),
        (r"x", r"a\nb"),
        (r"<.*?>", ""),
    ],
)
def test_replacements_as_in_python(spark, pattern, replacement):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(rx.replace_all(F.col("t"), pattern, replacement)).collect()]
    assert got == [re.sub(pattern, replacement, t) for t in TEXTS]


def test_word_characters_are_unicode(spark):
    df = spark.createDataFrame([("É!",), (" - ",)], "t string")
    assert [r[0] for r in df.select(word_characters(F.col("t"))).collect()] == ["É", ""]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert workdir.shared_dir(spark) == named
    df = spark.range(3)
    assert workdir.settle(df).count() == 3
    assert workdir.new_path(spark, "x") != workdir.new_path(spark, "x")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="word_trend: missing column"):
        wl.word_trend(spark.range(1))
