import random

import pandas as pd
import pytest

import wordloom as wl
from wordloom.functions import text as tx
from wordloom.operators import words
from pyspark.sql import functions as F

from .conftest import rows


def docs(spark, *texts, language="DE"):
    data = [(n + 1, language, t) for n, t in enumerate(texts)]
    return spark.createDataFrame(data, "text_id long, language string, text string")


def test_tokens_keep_inner_hyphens_and_digits(spark):
    df = docs(spark, "Covid-19, Rheinland-Pfalz - SPIEGEL-ID-Konto 2020")
    got = df.select(tx.tokens(F.col("text")).alias("t")).first()["t"]
    assert got == ["Covid-19", "Rheinland-Pfalz", "SPIEGEL-ID-Konto"]


def test_rule_types_counts_and_lengths(spark):
    df = docs(spark, "Haus haus Haus ab Ärzte", None, "")
    got = rows(wl.extract_words(df, types=("PROPN", "WORD"), max_word_len=4))
    assert got == [
        (1, "DE", "PROPN", "Haus", 2),
        (1, "DE", "PROPN", "Ärzt", 1),
        (1, "DE", "WORD", "haus", 1),
    ]


def test_languages_filter_takes_a_list(spark):
    df = docs(spark, "Haus").union(docs(spark, "Maison", language="FR"))
    assert rows(wl.extract_words(df, languages=["FR"]), "word") == [("Maison",)]
    with pytest.raises(TypeError):
        wl.extract_words(df, languages="DE")


def test_unsupported_languages_are_reported(spark):
    df = docs(spark, "a", language="XX").union(docs(spark, "b"))
    assert rows(wl.unsupported_languages(df)) == [("XX", 1)]
    df = docs(spark, "Haus", language="XX")
    assert wl.extract_words(df).count() == 0
    assert wl.extract_words(df, supported=None).count() == 1


def annotations(spark):
    return spark.createDataFrame(
        [
            ("DE", "Häuser", "Haus", "NOUN"),
            ("DE", "ging", "gehen", "VERB"),
            ("DE", "Merkel", "Merkel", "PROPN"),
            ("DE", "doppelt", "z", "VERB"),
            ("DE", "doppelt", "a", "NOUN"),
        ],
        "language string, surface string, lemma string, pos string",
    )


def test_annotations_give_lemma_and_type(spark):
    df = docs(spark, "Häuser ging Merkel doppelt Berlin unbekannt")
    got = rows(
        wl.extract_words(df, annotations(spark), types=("PROPN", "NOUN"), min_word_len=1),
        "type",
        "word",
    )
    assert got == [("NOUN", "Haus"), ("NOUN", "a"), ("PROPN", "Berlin"), ("PROPN", "Merkel")]


def test_entities_up_to_three_words(spark):
    gazetteer = spark.createDataFrame(
        [
            ("DE", "Angela Merkel", "PER"),
            ("DE", "Bank of England", "ORG"),
            ("DE", "England", "LOC"),
            ("DE", "England", "ORG"),
            ("FR", "Paris", "LOC"),
        ],
        "language string, phrase string, label string",
    )
    df = docs(spark, "Angela Merkel und Bank of England, Paris.", "Angela", "")
    got = rows(wl.extract_words(df, gazetteer=gazetteer, types=()), "text_id", "type", "word")
    assert got == [
        (1, "LOC", "England"),
        (1, "ORG", "Bank of England"),
        (1, "ORG", "England"),
        (1, "PER", "Angela Merkel"),
    ]
    both = wl.extract_words(df, gazetteer=gazetteer)
    plain = wl.extract_words(df)
    assert rows(both.where("type = 'PROPN'")) == rows(plain)
    joined = wl.extract_words(df, gazetteer=gazetteer, broadcast=False)
    assert rows(joined) == rows(both)
    longer = spark.createDataFrame([("DE", "a b c d e f g h", "ORG")], gazetteer.schema)
    found = wl.extract_words(docs(spark, "x a b c d e f g h a b c d e f g h"), gazetteer=longer, types=())
    assert rows(found, "word", "count") == [("a b c d e f g h", 2)]


def test_annotator_runs_once_per_partition(spark):
    def annotator(batches):
        model = {"loaded": 1}
        for batch in batches:
            out = [(i, l, "PER", t.upper() * model["loaded"]) for i, l, t in batch.values]
            yield pd.DataFrame(out, columns=["text_id", "language", "type", "word"])

    df = docs(spark, "abc", None, "x")
    assert rows(wl.extract_words(df, annotator=annotator)) == [(1, "DE", "PER", "ABC", 1)]


def test_keep_empty_documents(spark):
    tokens = wl.annotate_tokens(docs(spark, "Haus", ""), keep_empty=True)
    assert rows(tokens, "text_id", "lemma", "pos") == [(1, "Haus", "PROPN"), (2, None, None)]


def _brute_phrases(docs, gazetteer):
    from collections import Counter

    found = Counter()
    for text_id, language, text in docs:
        words = (text or "").split()
        listed = {p for code, p, _ in gazetteer if code == language and " " in p}
        for i, word in enumerate(words):
            found[text_id, language, word] += 1
            for n in range(2, len(words) - i + 1):
                run = " ".join(words[i : i + n])
                if run in listed:
                    found[text_id, language, run] += 1
    return {(*k, n) for k, n in found.items()}


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_phrases_along_the_trie(spark, broadcast):
    """Phrases that begin, contain or overlap each other, up to twelve words, in two languages."""
    rng = random.Random(3)
    long = "a b a b c a b c d a b c"
    gazetteer = [("EN", p, "ORG") for p in ("a b", "a b c", "b c d", "c a", "a b c d e", "a a a", "d", "a b", long, "z a")]
    gazetteer += [("DE", "a b", "PER"), ("DE", "a b", "LOC"), ("EN", "a b", "LOC")]
    docs = [(i, rng.choice(["EN", "DE", "FR"]), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs += [(100, "EN", long + " " + long), (101, "EN", None), (102, "EN", ""), (103, "EN", "a"), (104, None, "a b")]
    df = spark.createDataFrame(docs, "text_id long, language string, text string")
    listed = spark.createDataFrame(gazetteer, "language string, phrase string, label string")
    got = {tuple(r) for r in words.count_phrases(df, listed, broadcast).collect()}
    assert got == _brute_phrases(docs, gazetteer)


def test_trie_has_one_row_per_beginning(spark):
    listed = spark.createDataFrame(
        [("EN", "a b c", "ORG"), ("EN", "a b", "ORG"), ("EN", "a b d", "PER"), ("EN", "x", "LOC")],
        "language string, phrase string, label string",
    )
    got = {tuple(r) for r in words.phrase_trie(listed).collect()}
    assert got == {("EN", 2, "a b", True), ("EN", 3, "a b c", True), ("EN", 3, "a b d", True)}


def test_phrase_list_without_long_phrases(spark):
    df = spark.createDataFrame([(1, "EN", "a b a")], "text_id long, language string, text string")
    for rows in ([], [("EN", "a", "ORG")]):
        listed = spark.createDataFrame(rows, "language string, phrase string, label string")
        got = {tuple(r) for r in words.count_phrases(df, listed).collect()}
        assert got == {(1, "EN", "a", 2), (1, "EN", "b", 1)}
