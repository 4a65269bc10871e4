"""Words of documents: tokens, part of speech and lemma by table, entities by table.

Trained language models are not part of this library. Words are found by a token pattern, looked
up in an ``annotations(language, surface, lemma, pos)`` table and, for entities, in a
``gazetteer(language, phrase, label)`` table; so the words differ from those a model would give.
A model can be plugged in through ``annotator``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.joins import HOT_KEYS, fits_broadcast, lookup_join
from ..functions.masks import one_of, sum_counts
from ..functions.workdir import settle
from ..schemas import require_columns

WORD_TYPES = ("PROPN", "NOUN")
ENTITY_TYPES = ("ORG", "PER", "LOC")
# Languages words can be taken from.
SUPPORTED_LANGUAGES = ("EN", "DE", "ES", "FR", "IT", "LT", "NB", "NL", "PT")

Annotator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

_ANNOTATED = "text_id {id_type}, language string, type string, word string"


def rule_type(surface: Column) -> Column:
    """Type of a word no annotation knows: capitalised words count as proper nouns.

    ASCII letters are told apart by comparison; only other first letters need the pattern.
    """
    return (
        F.when(surface.isNull(), F.lit(None).cast("string"))
        .when((surface >= "A") & (surface < "["), F.lit("PROPN"))
        .when((surface >= "a") & (surface < "{"), F.lit("WORD"))
        .when(surface.rlike(tx.CAPITALISED), F.lit("PROPN"))
        .otherwise(F.lit("WORD"))
    )


def one_annotation(annotations: DataFrame) -> DataFrame:
    """One (lemma, pos) per (language, surface): the smallest by pos, then lemma."""
    best = F.min(F.struct("pos", "lemma")).alias("best")
    return (
        annotations.groupBy("language", "surface")
        .agg(best)
        .select("language", "surface", "best.pos", "best.lemma")
    )


def unsupported_languages(
    docs: DataFrame, supported: Sequence[str] = SUPPORTED_LANGUAGES
) -> DataFrame:
    """Documents per language that no word extraction covers."""
    return (
        docs.where(~one_of("language", supported))
        .groupBy("language")
        .agg(F.count(F.lit(1)).alias("docs"))
    )


def annotate_tokens(
    docs: DataFrame,
    annotations: DataFrame | None = None,
    keep_empty: bool = False,
    broadcast: bool | None = None,
) -> DataFrame:
    """One row per document and distinct word: (text_id, language, surface, lemma, pos, count).

    Words are counted before they are looked up. With ``keep_empty`` a document without words yields
    one row with a NULL word. ``broadcast`` says whether the annotations are small; None measures.
    """
    unroll = F.explode_outer if keep_empty else F.explode
    rows = docs.select("text_id", "language", unroll(tx.tokens(F.col("text"))).alias("surface"))
    rows = rows.groupBy("text_id", "language", "surface").agg(F.count(F.lit(1)).alias("count"))
    surface = F.col("surface")
    if annotations is None:
        return rows.select(
            "text_id", "language", "surface", surface.alias("lemma"), rule_type(surface).alias("pos"), "count"
        )
    joined = lookup_join(
        rows, one_annotation(annotations), ["language", "surface"], "left", small=_is_small(annotations, broadcast)
    )
    return joined.select(
        "text_id",
        "language",
        "surface",
        F.coalesce("lemma", surface).alias("lemma"),
        F.coalesce("pos", rule_type(surface)).alias("pos"),
        "count",
    )


def _is_small(table: DataFrame, broadcast: bool | None) -> bool:
    return fits_broadcast(table) if broadcast is None else broadcast


def phrase_trie(gazetteer: DataFrame) -> DataFrame:
    """(language, n, prefix, ends): the beginnings of two words or more of all phrases, each once.

    ``ends``: whether the beginning is a whole phrase. As many rows as the phrases' trie has nodes.
    """
    words = F.split("phrase", " ")
    first = gazetteer.select("language", words.alias("w")).where(F.size("w") > 1)
    nodes = F.transform(F.sequence(F.lit(2), F.size("w")), _beginning)
    each = first.select("language", F.explode(nodes).alias("node")).select("language", "node.*")
    return each.groupBy("language", "n", "prefix").agg(F.max("ends").alias("ends"))


def _beginning(n: Column) -> Column:
    return F.struct(
        n.alias("n"),
        F.array_join(F.slice(F.col("w"), F.lit(1), n), " ").alias("prefix"),
        (n == F.size("w")).alias("ends"),
    )


def _with_phrases(positions: DataFrame, trie: DataFrame, longest: int, keep: bool, small: bool) -> DataFrame:
    """``positions`` (.., language, ahead) with ``found``: the phrases that begin there.

    ``ahead``: the word and those that follow. A position goes on to n words only if the n - 1 words before
    are the beginning of a phrase, so the rows never grow. ``keep`` also keeps positions that no phrase
    begins with; without it the first join drops them before anything else is done.
    """
    ahead = F.col("ahead")
    rows = positions.withColumns({
        "found": F.array().cast("array<string>"),
        "prefix": F.when(F.size(ahead) > 1, F.array_join(F.slice(ahead, 1, 2), " ")),
    })
    for n in range(2, longest + 1):
        level = trie.where(F.col("n") == n).select("language", "prefix", "ends")
        how = "left" if keep or n > 2 else "inner"
        rows = lookup_join(rows, level, ["language", "prefix"], how, small=small)
        further = F.col("ends").isNotNull() & (F.size(ahead) > n)
        rows = rows.withColumns({
            "found": F.when(F.col("ends"), F.concat("found", F.array("prefix"))).otherwise(F.col("found")),
            "prefix": F.when(further, F.array_join(F.slice(ahead, 1, n + 1), " ")),
        }).drop("ends")
    return rows.drop("prefix")


# Bits of the map of beginnings that positions are held against before they are shuffled: a million rows of 64.
_MAP_BITS = 1 << 26


def _maybe_begins(positions: DataFrame, trie: DataFrame) -> DataFrame:
    """``positions`` without most of those whose first two words begin no phrase.

    A bit per hash of two words, in rows of 64, so the broadcast has a fixed size however long the list is; a
    position whose bit is set by other words goes on and is dropped by the join that follows.
    """
    bit = F.pmod(F.xxhash64("prefix"), F.lit(_MAP_BITS))
    row, place = F.shiftright(bit, 6), (bit % 64).cast("int")
    bits = trie.where(F.col("n") == 2).select(row.alias("__row"), F.expr("1L").alias("one"), place.alias("place"))
    table = bits.groupBy("__row").agg(F.bit_or(F.expr("shiftleft(one, place)")).alias("__bits"))
    held = positions.where(F.size("ahead") > 1).withColumn("prefix", F.array_join(F.slice("ahead", 1, 2), " "))
    held = held.withColumns({"__at": row, "__place": place}).join(F.broadcast(table), F.col("__at") == F.col("__row"))
    return held.where(F.expr("(shiftrightunsigned(__bits, __place) & 1L) = 1")).select(positions.columns)


def _counted(
    docs: DataFrame, gazetteer: DataFrame, broadcast: bool | None
) -> tuple[DataFrame, DataFrame | None]:
    """Counts per document (text_id, language, phrase, count): its words, and the phrases of the list in it.

    One table of both where the trie is broadcast. Otherwise two: a word holds no blank and a phrase does, so each
    is counted for itself, and words stay where their document is.
    """
    trie = settle(phrase_trie(gazetteer), "phrase-trie")  # read once per level
    longest = trie.agg(F.max("n")).first()[0] or 1
    words = docs.select("text_id", "language", tx.tokens(F.col("text")).alias("words"))

    def counts(rows):
        return rows.groupBy("text_id", "language", "phrase").agg(F.count(F.lit(1)).alias("count"))

    if longest == 1:
        return counts(words.select("text_id", "language", F.explode("words").alias("phrase"))), None
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"))).otherwise(F.array().cast("array<int>"))
    ahead = F.explode(F.transform(starts, lambda at: F.slice(F.col("words"), at, F.lit(longest))))
    positions = words.select("text_id", "language", ahead.alias("ahead"))
    if _is_small(trie, broadcast):
        met = _with_phrases(positions, trie, longest, True, True)
        both = F.explode(F.concat(F.slice("ahead", 1, 1), "found"))
        return counts(met.select("text_id", "language", both.alias("phrase"))), None
    met = _with_phrases(_maybe_begins(positions, trie), trie, longest, False, False)
    return (
        counts(words.select("text_id", "language", F.explode("words").alias("phrase"))),
        counts(met.select("text_id", "language", F.explode("found").alias("phrase"))),
    )


def count_phrases(docs: DataFrame, gazetteer: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(text_id, language, phrase, count): the words of each document and the phrases of the list in it.

    Phrases are found along the trie of their words, so a document sends its words and its phrases
    through the shuffle, never all runs of words, however long the phrases are. A trie too large for a
    broadcast is met by shuffled joins of the positions whose first two words begin a phrase, as far as a map of
    bits can tell.
    """
    words, phrases = _counted(docs, gazetteer, broadcast)
    return words if phrases is None else words.unionByName(phrases)


def _as_words(rows: DataFrame, annotations: DataFrame | None, broadcast: bool | None, is_word: Column | None) -> tuple:
    """``rows`` with what is known of their words, and the (pos, lemma) of those."""
    if annotations is None:
        return rows, rule_type(F.col("phrase")), F.col("phrase")
    table = one_annotation(annotations).withColumnRenamed("surface", "phrase")
    small = _is_small(annotations, broadcast)
    rows = lookup_join(rows, table, ["language", "phrase"], "left", condition=is_word, small=small)
    return rows, F.coalesce("pos", rule_type(F.col("phrase"))), F.coalesce("lemma", "phrase")


def _entities(words: DataFrame, phrases: DataFrame, labels: DataFrame, small: bool) -> DataFrame:
    """One row per label of a phrase, or of a word that the list has as a phrase."""
    on = ["language", "phrase"]
    entries = labels.groupBy(*on).agg(F.collect_set("label").alias("labels"))
    alone = entries.where(~F.col("phrase").contains(" ")).select(*on)
    if not labels.where(~F.col("phrase").contains(" ")).isEmpty():
        phrases = phrases.unionByName(lookup_join(words, alone, on, "semi", small=small))
    return lookup_join(phrases, entries, on, "inner", small=small).select(
        "text_id", "language", F.explode("labels").alias("type"), F.col("phrase").alias("word"), "count"
    )


def _annotated_apart(words: DataFrame, table: DataFrame) -> DataFrame:
    """Stored ``words`` with the annotations of a list that is shuffled: (.., pos, lemma).

    The most frequent words are answered from a broadcast of fixed size and stay where they are; only rows of
    the others move to their annotation.
    """
    on = ["language", "phrase"]
    counted = words.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot = settle(counted.orderBy(F.col("n").desc(), *on).limit(HOT_KEYS).select(*on), "frequent-words")
    known = F.broadcast(settle(lookup_join(hot, table, on, "left", small=False), "frequent-annotations"))
    cold = words.join(F.broadcast(hot), on, "left_anti")
    columns = [*words.columns, "pos", "lemma"]
    return words.join(known, on).select(*columns).unionByName(
        lookup_join(cold, table, on, "left", small=False).select(*columns)
    )


def _tagged(
    docs: DataFrame,
    annotations: DataFrame | None,
    gazetteer: DataFrame | None,
    broadcast: bool | None,
    wanted: Sequence[str],
) -> DataFrame:
    """(text_id, language, type, word, count): words and entities, counted per document, then looked up."""
    if gazetteer is None:
        return annotate_tokens(docs, annotations, broadcast=broadcast).select(
            "text_id", "language", F.col("pos").alias("type"), F.col("lemma").alias("word"), "count"
        )
    runs, phrases = _counted(docs, gazetteer, broadcast)
    labels = gazetteer.select("language", "phrase", "label")
    if phrases is not None:
        # Step by step, each stored: the shuffle files of a step go before the next one makes its own.
        phrases = settle(phrases, "document-phrases")  # most of the shuffles, so before the words are stored
        words = settle(runs, "document-words")
        entities = _entities(words, phrases, labels, _is_small(gazetteer, broadcast))
        entities = settle(entities.where(F.col("type").isin(wanted)), "document-entities")
        if annotations is None or _is_small(annotations, broadcast):
            rows, pos, lemma = _as_words(words, annotations, True, None)
        else:
            table = settle(one_annotation(annotations).withColumnRenamed("surface", "phrase"), "annotations")
            rows = _annotated_apart(words, table)
            pos, lemma = F.coalesce("pos", rule_type(F.col("phrase"))), F.coalesce("lemma", "phrase")
        rows = rows.select("text_id", "language", pos.alias("type"), lemma.alias("word"), "count")
        return settle(rows.where(F.col("type").isin(wanted)), "typed-words").unionByName(entities)
    single = ~F.col("phrase").contains(" ")
    on = ["language", "phrase"]

    # Entities: one row per label of a run.
    labels = labels.distinct()
    no_label = F.lit(None).cast("string")
    # A run that is a word comes once more without label, for the word itself.
    listed = labels.unionByName(labels.select(*on).distinct().withColumn("label", no_label))
    met = lookup_join(runs, listed, on, "left", small=_is_small(gazetteer, broadcast))
    rows = met.where(single | F.col("label").isNotNull())
    is_word = F.col("label").isNull()
    rows, pos, lemma = _as_words(rows, annotations, broadcast, is_word)
    return rows.select(
        "text_id",
        "language",
        F.when(is_word, pos).otherwise(F.col("label")).alias("type"),
        F.when(is_word, lemma).otherwise(F.col("phrase")).alias("word"),
        "count",
    )


def extract_words(
    docs: DataFrame,
    annotations: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    annotator: Annotator | None = None,
    types: Sequence[str] = WORD_TYPES,
    entity_types: Sequence[str] = ENTITY_TYPES,
    languages: Sequence[str] | None = None,
    supported: Sequence[str] | None = SUPPORTED_LANGUAGES,
    max_word_len: int = 80,
    min_word_len: int = 3,
    broadcast: bool | None = None,
) -> DataFrame:
    """Count words per (text_id, language, type, word).

    ``annotator`` receives batches (text_id, language, text) and yields batches
    (text_id, language, type, word); it is called once per partition, so it loads its model once.
    ``broadcast`` says whether the tables are small enough for every executor; None measures them.
    Documents are filtered by language before any work on the text: those in ``languages`` and in
    ``supported`` (``unsupported_languages`` reports the others). Missing texts have no words.
    When the documents are already partitioned by id the count needs no shuffle. Otherwise, with
    unique ids, ``repartition("text_id")`` first: texts are smaller than their word rows.
    """
    require_columns(docs, ["text_id", "language", "text"], "extract_words")
    docs = docs.where(one_of("language", languages) & one_of("language", supported))
    if annotator is not None:
        docs = docs.where(F.col("text").isNotNull())
        id_type = docs.schema["text_id"].dataType.simpleString()
        rows = docs.select("text_id", "language", "text").mapInPandas(
            annotator, _ANNOTATED.format(id_type=id_type)
        ).withColumn("count", F.lit(1))
    else:
        rows = _tagged(docs, annotations, gazetteer, broadcast, [*types, *entity_types])
    wanted = [*types, *entity_types]
    rows = rows.where(F.col("type").isin(wanted)).select(
        "text_id", "language", "type", F.substring("word", 1, max_word_len).alias("word"), "count"
    )
    rows = rows.where(F.length("word") >= min_word_len)
    return sum_counts(rows, ["text_id", "language", "type", "word"])
