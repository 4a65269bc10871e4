import pytest
from pyspark.sql import Observation, functions as F

import wordloom as wl
from wordloom.operators.docs import UNICODE_REPLACEMENTS

from .conftest import rows

GLUED = [
    (1, "DE", "Der Zug kam.Alle stiegen ein! Nur Tom ?Wohl kaum."),
    (2, "DE", "Regen,aber warm.Abends wird es klar ."),
    (3, "DE", ' Dann rief er " ihr da":Kommt ihr mit?."NEIN"'),
]


def docs(spark, data, schema="text_id long, language string, text string"):
    return spark.createDataFrame(data, schema)


def test_repairs_missing_blanks(spark):
    assert rows(wl.prepare_docs(docs(spark, GLUED))) == [
        (1, "DE", "Der Zug kam. Alle stiegen ein! Nur Tom ? Wohl kaum."),
        (2, "DE", "Regen, aber warm. Abends wird es klar ."),
        (3, "DE", ' Dann rief er " ihr da": Kommt ihr mit?. "NEIN"'),
    ]


def test_default_patterns_know_ascii_capitals_only(spark):
    df = docs(spark, [(1, "DE", "Ende.Über")])
    assert rows(wl.prepare_docs(df)) == [(1, "DE", "Ende.Über")]
    assert rows(wl.prepare_docs(df, replacements=UNICODE_REPLACEMENTS)) == [(1, "DE", "Ende. Über")]


def test_one_row_per_id_first_by_order(spark):
    df = docs(
        spark,
        [(1, "DE", "zwei", 2), (1, "FR", "eins", 1), (2, "DE", "b", 5), (2, "DE", "a", 5)],
        "text_id long, language string, text string, at int",
    )
    got = rows(wl.prepare_docs(df, order_by=["at"]))
    assert got == [(1, "FR", "eins"), (2, "DE", "a")]


def test_seen_ids_are_dropped(spark):
    df = docs(spark, GLUED)
    first = wl.prepare_docs(df)
    assert wl.prepare_docs(df, seen=first.select("text_id")).count() == 0


def test_missing_language_gets_default_only_there(spark):
    df = docs(spark, [(1, None, "a"), (2, "FR", "b")])
    assert rows(wl.prepare_docs(df, default_language="EN")) == [(1, "EN", "a"), (2, "FR", "b")]


def test_no_language_column(spark):
    df = docs(spark, [(1, "a")], "text_id long, text string")
    assert rows(wl.prepare_docs(df)) == [(1, "DE", "a")]


def test_language_by_medium(spark):
    df = docs(
        spark,
        [(1, "Lemonde", "a"), (2, "Elpais", "b"), (3, "Spiegel", "c"), (4, "Other", "d"), (5, None, "e")],
        "text_id long, media string, text string",
    )
    got = rows(wl.prepare_docs(df, media_languages={"Lemonde": "FR", "Elpais": "ES"}))
    assert [r[1] for r in got] == ["FR", "ES", "DE", "DE", "DE"]


def test_bytes_are_decoded_and_bad_bytes_become_null(spark):
    df = docs(
        spark,
        [(1, "DE", bytearray("Größe".encode())), (2, "DE", bytearray(b"\xff\xfe"))],
        "text_id long, language string, text binary",
    )
    assert rows(wl.prepare_docs(df)) == [(1, "DE", "Größe"), (2, "DE", None)]


def test_tags_are_stripped_within_a_line(spark):
    df = docs(spark, [(1, "DE", "<b>x</b> <a\nhref> y <i>\r</i>")])
    got = rows(wl.prepare_docs(df, strip_html=True, replacements={}))
    assert got == [(1, "DE", "x <a\nhref> y \r")]


def test_configured_column_names(spark):
    df = docs(spark, [(7, "FR", "a")], "ID long, lang string, body string")
    got = wl.prepare_docs(df, text_col="body", id_col="ID", language_col="lang")
    assert got.columns == ["text_id", "language", "text"] and rows(got) == [(7, "FR", "a")]
    with pytest.raises(ValueError, match="missing column"):
        wl.prepare_docs(df)


def test_row_count_is_observed(spark):
    seen = Observation("prepared")
    wl.prepare_docs(docs(spark, GLUED + GLUED), observation=seen).collect()
    assert seen.get["rows"] == 3


def test_one_shuffle_from_documents_to_words(spark):
    words = wl.documents_to_words(docs(spark, GLUED))
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_select_docs(spark):
    df = docs(spark, GLUED)
    got = wl.select_docs(df, ["text_id AS id", "upper(language) AS l"], "text_id NOT IN (1)")
    assert rows(got) == [(2, "DE"), (3, "DE")]
    assert wl.select_docs(df, ["text_id"], F.col("text_id") == 1).count() == 1
