"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_counts(docs, least=6, most_rare=5, every=199):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= most_rare}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, factor=5):
    form, near = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if one_apart(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        near[w] = len(found)
        form[w] = best if best and counts[best] >= factor * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return out


def variants(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {tuple(r) for r in spelling.spelling_variants(df, **options).select(*COLUMNS).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words(spark, seed):
    """Few letters, so that words have many near words, runs of equal letters, ties and chains."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 8))) for _ in range(400)}
    counts = {w: 5 ** rng.randint(0, 6) for w in words}
    assert variants(spark, counts) == plain_variants(counts)


def test_letters_skipped_once(spark):
    """Deleting any of a run of equal letters gives one near word, not several."""
    counts = {"aaaaaa": 1, "aaaaaaa": 7, "aaabaaa": 1, "baaaaa": 7}
    got = variants(spark, counts)
    assert got == plain_variants(counts)
    assert ("aaaaaa", "aaaaaaa", "aaaaaaa", 1, 3, 7) in got  # two near words of 7: the least by code point


def test_chain_of_forms(spark):
    counts = {"abcdef": 1, "abcdeg": 5, "abcdhg": 25, "abchhg": 125, "zzzzzz": 9}
    assert variants(spark, counts) == plain_variants(counts)
    assert ("abcdef", "abcdeg", "abchhg", 1, 1, 5) in variants(spark, counts)


def test_long_chain(spark):
    """As long as longs allow: the root is still reached."""
    counts = {"x" * i + "q" * (26 - i): 5**i for i in range(26)}
    got = {w: root for w, _, root, *_ in variants(spark, counts)}
    assert got == {w: root for w, _, root, *_ in plain_variants(counts)}
    assert set(got.values()) == {"x" * 25 + "q"}


def test_hot_pattern(spark):
    """All words that share all but one letter: each meets the count of the group, not every other."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    counts = {f"abc{c}def": 10 + ord(c) for c in letters} | {"abcdef": 1, "abddef": 3}
    assert variants(spark, counts) == plain_variants(counts)


def test_documents(spark):
    rng = random.Random(5)
    words = ["Straße", "straße", "STRASSE", "straÃe", "Überall", "überall", "×abcdef÷ghijkl", "kurz", "abcdefg"]
    docs = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(30))) for i in range(80)]
    docs += [(900, None), (901, ""), (902, "...ŸĀ"), docs[3], docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("word", "n", "id", "run", "lead", "nodes")}
    )
    counts = plain_counts(docs, every=13)
    assert {tuple(r) for r in spelling.word_counts(df, every=13).collect()} == set(counts.items())
    got = {tuple(r) for r in spelling.group_spellings(df, every=13).select(*COLUMNS).collect()}
    assert got == plain_variants(counts)


def test_long_runs(spark):
    """Runs of 30,000 letters cost their length, not its square."""
    rng = random.Random(3)
    run = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    docs = [(i, run if i % 2 else run[:15_000] + "z" + run[15_001:]) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spelling.group_spellings(df, every=10**9).collect()
    assert sorted((len(r["word"]), r["n"], r["n_near"], r["form"]) for r in got) == [(30_000, 6, 1, None)] * 2


def test_nodes_stand_for_prefixes(spark):
    words = ["abcd", "abcde", "abcdé", "abcdef", "abcz", "bbcd", "àbcd", "abcdeé"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    nodes = {r["word"]: r["nodes"] for r in spelling.trie_nodes(df).collect()}
    by_prefix, by_node = {}, {}
    for w in words:
        assert len(nodes[w]) == len(w) + 1
        for i, node in enumerate(nodes[w]):
            assert by_prefix.setdefault(w[:i], node) == node
            assert by_node.setdefault(node, w[:i]) == w[:i]
    assert sorted(words) == sorted(words, key=lambda w: nodes[w][-1])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_spellings(docs).columns == COLUMNS
    assert spelling.group_spellings(docs).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "word string, n long"), factor=1)
