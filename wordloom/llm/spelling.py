"""Spelling variants: words one code point apart, found by pairs of trie nodes.

The nodes of a trie over the words and of one over the reversed words are numbered. A word cut at a place is
the pair (node of what stands before, node of what stands behind), so two integers stand for the whole
word. Two words differ by one replaced code point exactly if they have the same pair around a place that
both skip, and by an inserted or deleted one exactly if the pair around a skipped place of the longer is the pair
at a cut of the shorter. One grouping by pairs therefore finds all near words; a group holds one word
cut there and at most one word for each letter at the skipped place, so its size is bounded by the alphabet,
and each member needs only the group's count and its two most frequent words, never the pairs of members.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.workdir import settle

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
TYPO_EVERY = 199

# Nodes up to this depth are numbered by their letters, deeper ones in order below their first LEAD letters.
LEAD = 4
# A form is FACTOR times as frequent as its variant, so 2 ** JUMPS steps reach the end of any chain of longs.
JUMPS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, least: int = 1) -> Column:
    """All maximal runs of at least ``least`` letters."""
    return F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def with_typos(doc_id: Column, run: Column, every: int = TYPO_EVERY) -> Column:
    """The run, in one of ``every`` pairs of document and run without one of its code points."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(run)


def word_counts(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = TYPO_EVERY
) -> DataFrame:
    """word, n of all words of ``docs`` (doc_id, text) long and frequent enough, typos put in.

    NULL and empty texts have no words; a NULL id counts as an empty one; repeated rows count each;
    other columns are ignored. Partial sums shrink frequent words before the shuffle.
    """
    long_runs = runs(F.col("text").cast("string"), min_length)  # a typo never makes a run longer
    found = docs.select(F.col("doc_id").alias("id"), F.explode(long_runs).alias("run"))
    words = found.select(with_typos(F.col("id"), lower_ascii(F.col("run")), every).alias("word"))
    counted = words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all prefixes of sorted words: letters of the short ones, ranks below their lead of the deep ones."""
    lead, before, short, path, used = None, "", [], [], 0
    for batch in batches:
        nodes = []
        for word in batch.column("word").to_pylist():
            if word[:LEAD] != lead:
                lead, before, short, path, used = word[:LEAD], "", [0], [], 0
                for letter in lead:
                    short.append(short[-1] << 8 | ord(letter))
                short[-1] <<= 31  # room for the nodes below
            shared, most = LEAD, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            # The path below the lead: what is shared with the word before, then new nodes.
            del path[shared - LEAD :]
            first = short[-1] + used + 1
            path.extend(range(first, first + len(word) - shared))
            used += len(word) - shared
            before = word
            nodes.append(short + path)
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), pa.array(nodes, pa.list_(pa.int64()))], names=["word", "nodes"]
        )


def trie_nodes(words: DataFrame) -> DataFrame:
    """word, nodes: numbers of the trie nodes of its prefixes, from the empty one to the whole word.

    ``words``: distinct words of at least LEAD code points up to U+00FF. Equal prefixes get equal numbers,
    different ones different numbers; the numbers of whole words follow their code-point order. Words are dealt
    by their first letters and sorted; a task goes through its words with one path in memory.
    """
    dealt = words.select("word", F.substring("word", 1, LEAD).alias("lead")).repartition("lead")
    return dealt.sortWithinPartitions("word").mapInArrow(_number, "word string, nodes array<bigint>")


def _letters(word: Column) -> Column:
    return F.split(word, "")


def _pairs(words: DataFrame) -> DataFrame:
    """before, behind, id, n, cut, first: the pairs of nodes of each word, around skipped places and at cuts.

    ``first``: the skipped place starts a run of equal letters; skipping any other place of the run gives the
    same string, so only this one stands for the deletion.
    """
    length = F.size("prefixes") - 1
    letters = F.col("letters")

    def around(i: Column) -> Column:
        same = (i > 0) & (F.get(letters, i) == F.get(letters, i - 1))
        return F.struct(
            F.get("prefixes", i).alias("before"), F.get("suffixes", length - i - 1).alias("behind"),
            F.lit(False).alias("cut"), (~same).alias("first"),
        )

    def at(i: Column) -> Column:
        return F.struct(
            F.get("prefixes", i).alias("before"), F.get("suffixes", length - i).alias("behind"),
            F.lit(True).alias("cut"), F.lit(True).alias("first"),
        )

    skipped = F.transform(F.sequence(F.lit(0), length - 1), around)
    whole = F.transform(F.sequence(F.lit(0), length), at)
    pair = F.explode(F.concat(skipped, whole)).alias("pair")
    return words.select("id", "n", pair).select("pair.*", "id", "n")


def _best_other(ranked: Column, member: Column) -> Column:
    """The first of ranked members that is not the member itself."""
    first = F.get(ranked, F.lit(0))
    return F.when(first["id"] == member["id"], F.get(ranked, F.lit(1))).otherwise(first)


def _near(pairs: DataFrame) -> DataFrame:
    """id, n_near, best (rank, id): near words of each word, counted and the most frequent one."""
    # Falling count and rising id: the order of preference as a sort key.
    member = F.struct((-F.col("n")).alias("rank"), "id", "cut", "first")
    groups = pairs.groupBy("before", "behind").agg(F.sort_array(F.collect_list(member)).alias("all"))
    groups = groups.where(F.size("all") > 1).select(
        F.filter("all", lambda m: ~m["cut"]).alias("skips"),
        F.filter("all", lambda m: ~m["cut"] & m["first"]).alias("longer"),
        F.filter("all", lambda m: m["cut"]).alias("cuts"),
    )
    nothing = F.lit(None).cast("struct<rank: bigint, id: bigint, cut: boolean, first: boolean>")

    def replaced(m: Column) -> Column:
        others = (F.size("skips") - 1).cast("long")
        return F.struct(m["id"].alias("id"), others.alias("n_near"), _best_other(F.col("skips"), m).alias("best"))

    def deleted(m: Column) -> Column:  # a longer word and what is left of it, the one word cut here
        only = F.get("cuts", F.lit(0))
        return F.struct(m["id"].alias("id"), F.size("cuts").cast("long").alias("n_near"), only.alias("best"))

    def inserted(m: Column) -> Column:
        best = F.when(F.size("longer") > 0, F.get("longer", F.lit(0))).otherwise(nothing)
        return F.struct(m["id"].alias("id"), F.size("longer").cast("long").alias("n_near"), best.alias("best"))

    found = F.concat(F.transform("skips", replaced), F.transform("longer", deleted), F.transform("cuts", inserted))
    each = groups.select(F.explode(found).alias("f")).select(
        "f.id", "f.n_near", F.struct("f.best.rank", "f.best.id").alias("best")
    ).where("n_near > 0")
    return each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n): distinct words of letters up to U+00FF.

    Near words differ by exactly one inserted, deleted or replaced code point. ``form``: the near word of
    largest n (ties: the least in code-point order) if its n is at least ``factor`` times as large, else NULL.
    ``root``: the end of the chain of forms. Words of fewer than LEAD code points and NULL words are left
    out; an empty table gives an empty one.
    """
    if factor < 2:
        raise ValueError("factor: at least 2, so that chains of forms end")
    words = words.select("word", F.col("n").cast("long").alias("n")).where(F.char_length("word") >= LEAD)
    forward = trie_nodes(words).withColumnRenamed("nodes", "prefixes")
    backward = trie_nodes(words.select(F.reverse("word").alias("word"))).select(
        F.reverse("word").alias("word"), F.col("nodes").alias("suffixes")
    )
    known = words.join(forward, "word").join(backward, "word")
    known = settle(known.withColumn("id", F.element_at("prefixes", -1)), "spelling-nodes")
    near = _near(_pairs(known.withColumn("letters", _letters(F.col("word")))))
    plain = known.select("id", "word", "n")
    met = plain.join(near, "id", "left")
    form_n = -F.col("best.rank")
    taken = form_n >= F.lit(factor) * F.col("n")
    linked = settle(
        met.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best.id")).alias("form_id"), F.when(taken, form_n).alias("form_n"),
        ),
        "spelling-links",
    )
    names = linked.select(F.col("id").alias("named"), F.col("word").alias("name"))
    roots = _ends(linked.where("form_id is not null").select("id", F.col("form_id").alias("root_id")))
    out = linked.join(roots, "id", "left")
    out = out.join(names.withColumnRenamed("name", "form"), F.col("form_id") == F.col("named"), "left").drop("named")
    out = out.join(names.withColumnRenamed("name", "root"), F.col("root_id") == F.col("named"), "left").drop("named")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(links: DataFrame) -> DataFrame:
    """id, root_id: the last of each chain; each round doubles the steps and is stored."""
    for _ in range(JUMPS):
        onward = links.select(F.col("id").alias("at"), F.col("root_id").alias("onward"))
        met = links.join(onward, F.col("root_id") == F.col("at"), "left")
        moved = settle(
            met.select("id", F.coalesce("onward", "root_id").alias("root_id"), F.col("onward").isNotNull().alias("moved")),
            "spelling-roots",
        )
        links = moved.select("id", "root_id")
        if moved.where("moved").isEmpty():
            break
    return links


def group_spellings(docs: DataFrame, **options) -> DataFrame:
    """Spelling variants among the words of ``docs`` (doc_id, text); see ``word_counts`` for its rows."""
    return spelling_variants(settle(word_counts(docs, **options), "spelling-words"))
