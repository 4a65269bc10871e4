import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import wordloom as wl
from wordloom.functions import joins, regex as rx
from wordloom.operators import index

from .conftest import rows

SCHEMA = "text_id long, language string, type string, word string, count int"


def words(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def propn(spark, *pairs):
    return words(spark, *[(n, "DE", "PROPN", w, c) for n, (w, c) in enumerate(pairs)])


def test_word_index_limits(spark):
    df = words(
        spark,
        (1, "DE", "PROPN", "A", 3),
        (2, "DE", "PROPN", "A", 2),
        (1, "DE", "PROPN", "B", 4),
        (1, "DE", "ORG", "C", 1),
        (2, "DE", "ORG", "D", 2),
        (3, "DE", "NOUN", "E", 99),
        (3, "FR", "PROPN", "A", 99),
        (3, "DE", "PROPN", None, 99),
    )
    got = rows(wl.select_word_index(df, "DE", {"PROPN": 5, "ORG": 2}))
    assert got == [
        (1, "DE", "PROPN", "A", 3),
        (2, "DE", "ORG", "D", 2),
        (2, "DE", "PROPN", "A", 2),
    ]
    assert rows(wl.select_word_index(df), "word") == [("A",), ("A",), ("D",)]


def test_database_names_are_accepted(spark):
    df = propn(spark, ("A", 5)).toDF("HASH_TEXT", "LANGUAGE", "TYPE", "WORD", "COUNT")
    assert rows(wl.select_word_index(df)) == [(0, "DE", "PROPN", "A", 5)]


REMOVE = [r"\d", r"[<>]", r"^[*_]", r"[~%]$"]
REPLACE = {r"[;:%]": "/"}


def test_cleansing(spark):
    given = ["Turm7", "rot%", "*Stern", "x<y", "a;b", "u:", "plain"]
    data, changes = wl.clean_words(propn(spark, *[(w, 1) for w in given]), REMOVE, REPLACE)
    assert rows(data, "word") == [("a/b",), ("plain",), ("u/",)]
    assert rows(changes) == [
        ("*Stern", "*Stern", r"^[*_]", None),
        ("Turm7", "Turm7", r"\d", None),
        ("a;b", "a/b", None, r"[;:%]"),
        ("rot%", "rot/", r"[~%]$", r"[;:%]"),
        ("u:", "u/", None, r"[;:%]"),
        ("x<y", "x<y", r"[<>]", None),
    ]


def test_many_replacements_keep_the_plan_short(spark):
    replace = {f"{a}{b}": b + a for a in "abcdef" for b in "uvwxyz"}
    data, changes = wl.clean_words(propn(spark, ("auto", 1)), list(replace), replace)
    for df in (data, changes):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 30_000
    assert rows(changes, "word_orig", "word", "word_m") == [("auto", "uato", "au")]


def test_last_matching_removal_is_reported_and_order_of_replacements_counts(spark):
    df = propn(spark, ("a1b", 1), ("zz", 2))
    _, changes = wl.clean_words(df, [r"\d", "a"], {"z": "y", "yy": "Y"})
    assert rows(changes) == [("a1b", "a1b", "a", None), ("zz", "Y", None, "yy")]


def test_cleansing_counts_again_and_respects_the_mask(spark):
    df = words(
        spark,
        (1, "DE", "PROPN", "a;b", 1),
        (1, "DE", "PROPN", "a:b", 2),
        (1, "DE", "NOUN", "c9", 1),
        (1, "FR", "PROPN", "d9", 1),
        (1, "DE", "PROPN", "e9", 1),
        (None, "DE", "PROPN", "f", 1),
    )
    data, _ = wl.clean_words(df, [r"\d"], REPLACE, languages=["DE"])
    assert rows(data) == [
        (1, "DE", "NOUN", "c9", 1),
        (1, "DE", "PROPN", "a/b", 3),
        (1, "FR", "PROPN", "d9", 1),
    ]


def test_blacklist_is_exact_and_keeps_null_words(spark):
    df = words(
        spark,
        (1, "DE", "PROPN", "Jahr", 1),
        (2, "DE", "NOUN", "Jahr", 1),
        (3, "DE", "PROPN", "jahr", 1),
        (4, "DE", "PROPN", None, 1),
    )
    assert rows(wl.remove_blacklisted(df, ["Jahr", "Jahr"]), "text_id") == [(2,), (3,), (4,)]
    table = spark.createDataFrame([("Jahr",), (None,)], "w string")
    assert rows(wl.remove_blacklisted(df, table), "text_id") == [(2,), (3,), (4,)]
    assert rows(wl.remove_blacklisted(df, ["Jahr"], word_types=None), "text_id") == [(3,), (4,)]
    assert wl.remove_blacklisted(df, ["Jahr"], languages=["FR"]).count() == 4


LEXICON = [
    ("DE", "Apfel", "M", "Obst"),
    ("DE", "Birne", "M", "Obst"),
    ("DE", "Baum", "C", "Ein Baum"),
    ("DE", "Ast", "FM", "Teil"),
    ("DE", "Apfel", "X", "never"),
    ("DE", "Apfel", "m", "never"),
    ("DE", "Apfel", None, "never"),
]
LEXICON_SCHEMA = "language string, word string, mapping string, category string"
GIVEN = [("Apfelmus", 2), ("Ein Baum", 1), ("Ast", 3), ("Ast-Loch", 1), ("Holzbirne", 1)]


@pytest.fixture(params=[0, 1500])
def unrelated(request):
    """Rows that match nothing: any number of them changes nothing."""
    kinds = ("FM", "M", "C")
    return [("DE", f"Q{n}{'+' * (n % 7 == 0)}", kinds[n % 3], "never") for n in range(request.param)]


def test_lexicon_adds_categories(spark, unrelated):
    lexicon = spark.createDataFrame(LEXICON + unrelated, LEXICON_SCHEMA)
    df = propn(spark, *GIVEN, (None, 5))
    got = wl.map_lexicon(df, lexicon)
    assert rows(got.where("type = 'LEX'"), "word", "count") == [
        ("Ein Baum", 1),
        ("Obst", 2),
        ("Teil", 3),
    ]
    assert rows(got.where("type = 'PROPN'"), "word", "count") == sorted(GIVEN)


def test_lexicon_regexes_masks_and_repeats(spark, unrelated):
    lexicon = spark.createDataFrame(
        [
            ("DE", "Ha+s", "M", "X"),
            ("DE", "us$", "C", "X"),
            ("DE", "Haus", "FM", "X"),
            ("FR", "Ha", "M", "Y"),
            ("FR", "Hau.", "FM", "never"),
            *unrelated,
        ],
        LEXICON_SCHEMA,
    )
    df = words(
        spark,
        (1, "DE", "PROPN", "Haus", 2),
        (2, "DE", "PROPN", "Haaas", 1),
        (3, "DE", "NOUN", "Haus", 1),
    )

    def added(**options):
        return rows(
            wl.map_lexicon(df, lexicon, **options).where("type = 'LEX'"), "text_id", "word", "count"
        )

    assert added() == [(1, "X", 4), (1, "Y", 2), (2, "X", 1), (2, "Y", 1)]
    assert added(once_per_category=True) == [(1, "X", 2), (1, "Y", 2), (2, "X", 1), (2, "Y", 1)]
    assert added(match_language=True) == [(1, "X", 4), (2, "X", 1)]
    assert added(languages=["DE"]) == [(1, "X", 4), (2, "X", 1)]
    assert added(word_types=["NOUN"]) == [(3, "X", 2), (3, "Y", 1)]


def test_one_plan_equals_the_steps(spark):
    data = [(n, "DE", t, w, c) for n, (w, c) in enumerate(GIVEN * 3) for t in ("PROPN", "NOUN")]
    df = words(spark, *data, (1, "DE", "PROPN", "Jahr", 9), (1, "DE", "PROPN", "x1", 9))
    lexicon = spark.createDataFrame(LEXICON, LEXICON_SCHEMA)
    limits = {"PROPN": 4, "NOUN": 1}
    step = wl.select_word_index(df, "DE", limits)
    step, _ = wl.clean_words(step, REMOVE, {"-": " "}, languages=["DE"])
    step = wl.remove_blacklisted(step, ["Jahr"], languages=["DE"])
    step = wl.map_lexicon(step, lexicon, languages=["DE"])
    whole = wl.build_word_index(df, ["Jahr"], lexicon, "DE", limits, REMOVE, {"-": " "})
    assert rows(whole) == rows(step) and whole.count() > 0


def test_duplicates(spark):
    df = propn(spark, ("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 1))
    assert rows(wl.duplicate_report(df, ["word"])) == [(6, 3)]
    assert rows(wl.duplicate_report(df.limit(0), ["word"])) == [(0, 0)]


def test_wide_lexicon(spark):
    wide = spark.createDataFrame(
        [("WHO", "Weltgesundheits* WHO", " who "), ("Corona", "", None)],
        "keyword string, de string, fr string",
    )
    assert rows(wl.explode_wide_lexicon(wide)) == [
        ("DE", "WHO", "FM", "WHO"),
        ("DE", "Weltgesundheits", "M", "WHO"),
        ("FR", "who", "FM", "WHO"),
    ]


def hot_answers(left, right, n):
    """The most frequent keys with what the lookup holds of them."""
    keys = left.groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).select("word")
    return keys.join(right.withColumn("found", F.lit(True)), "word", "left")


@pytest.mark.parametrize("hot_keys", [0, 1, 3, 100])
@pytest.mark.parametrize("how", ["left", "inner", "semi", "anti"])
def test_shuffled_lookup_equals_broadcast(spark, hot_keys, how):
    data = [(n, "DE", "PROPN", f"w{n % 7 if n % 3 else 0}", n) for n in range(300)]
    left = words(spark, *data, (900, "DE", "PROPN", None, 1), (901, "FR", "PROPN", "w1", 1))
    right = spark.createDataFrame(
        [(f"w{n}", None if n == 2 else n) for n in (0, 1, 2, 5, 9)], "word string, value int"
    )
    condition = left["language"] == "DE"
    hot = hot_answers(left, right, hot_keys) if hot_keys else None

    def run(small):
        return rows(
            joins.lookup_join(left, right, ["word"], how, ["text_id"], condition, small=small, hot=hot)
        )

    assert run(False) == run(True)


def test_size_is_measured(spark, monkeypatch):
    df = spark.createDataFrame([("ab", 1), (None, 2)], "word string, n int")
    assert joins.measured_size(df) == (2, 34)
    assert joins.fits_broadcast(df)
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 1)
    assert not joins.fits_broadcast(df)


def test_hot_keys_spread_over_the_shuffle(spark):
    """A word with most of the rows, in and outside the lookup, must not fill one partition."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        names = ["hot", "lost", None, "hot", "lost"]
        data = [(n, "DE", "PROPN", names[n % 6] if n % 6 < 5 else f"w{n}", n) for n in range(6000)]
        left = words(spark, *data)
        right = spark.createDataFrame([("hot", 1)] + [(f"w{n}", n) for n in range(6000)], "word string, v int")
        hot = hot_answers(left, right, 10)
        for how in ("left", "anti"):
            out = joins.lookup_join(left, right, ["word"], how, ["text_id"], small=False, hot=hot)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin [__place" in plan
            sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
            assert len(sizes) == 4 and max(sizes) < 1.2 * sum(sizes) / 4
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)


def test_totals_are_shuffled_once(spark, tmp_path):
    data = [(n, "DE", "PROPN", f"w{n % 50}", 1) for n in range(500)]
    words(spark, *data).write.parquet(str(tmp_path / "w"))
    df = wl.select_word_index(spark.read.parquet(str(tmp_path / "w")))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ("abc", ["abc"]),
        ("^abc$", ["abc"]),
        ("ab.*cd", ["ab", "cd"]),
        ("a(bc)+d", ["a", "bc", "d"]),
        ("a(bc)?d", ["a", "d"]),
        ("ab|cd", []),
        ("x(ab|cd)y", ["x", "y"]),
        ("[ab]c", ["c"]),
        ("[a]c", ["ac"]),
        (r"\d+", []),
        (r"a\.b", ["a.b"]),
        (r"ab\bcd", ["abcd"]),
        ("(?i)abc", []),
        ("(?i:ab)cd", []),
        ("a{2,3}b", ["a", "b"]),
        ("a{0,3}b", ["b"]),
        ("(?=abc)d", ["d"]),
        ("(?:ab)", ["ab"]),
        ("(unclosed", []),
        ("", []),
    ],
)
def test_required_literals(pattern, literals):
    found = rx.required_literals(pattern)
    assert found == literals
    for text in ("abc", "abcd", "ababcdxy", "xaby", "abbcd", "aab", "ac", "bc", "abcbcd", "a.b", "xcdy", "12"):
        if found and re.search(pattern, text):
            assert all(f in text for f in found)


def test_patterns_meet_words_with_their_factors_only(spark):
    """2,000 patterns and 4,000 words: pairs are tried where a word holds the pattern's rarest letters."""
    vocabulary = [f"w{i:04d}x{j}" for i in range(2000) for j in (1, 2)]
    lexicon = [("EN", f"w{i:04d}x[12]$", "C", "c") for i in range(0, 4000, 2)] + [("EN", "[qz][89]", "C", "free"), ("EN", "zzzz.", "M", "absent")]
    df = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    rules = index.lexicon_rules(spark.createDataFrame(lexicon, "language string, word string, mapping string, category string"))
    pairs = index.lexicon_candidates(df, rules).select("word", "entry").collect()
    free = [p for p in pairs if p["entry"] == "[qz][89]"]
    assert len(free) == len(vocabulary)  # nothing is certain: it meets every word
    assert len(pairs) - len(free) < 10 * len(vocabulary)  # of 8 million
    matched = {(w, e) for _, e, _, _ in lexicon for w in vocabulary if e.startswith(w[:6])}
    assert matched <= {tuple(p) for p in pairs}


def test_patterns_of_all_kinds(spark):
    """Every kind of rule against every word, by brute force."""
    entries = ["ab", "abc", "a", "", "ab.", "^ab", "b$", "a.*d", "(ab|cd)", "[a-c]d", "x?bc", "(?i)AB", "abcdabcd", "abcde.", "cda+b"]
    lexicon = [("EN", e, m, f"{m}:{e}") for e in entries for m in ("FM", "M", "C")] + [("EN", "ab", "X", "never")]
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"AB", "abcdabcd"})
    df = spark.createDataFrame([(1, "EN", "PROPN", w, 1) for w in vocabulary], "text_id long, language string, type string, word string, count long")
    table = spark.createDataFrame(lexicon, "language string, word string, mapping string, category string")
    got = index.map_lexicon(df, table).where("type = 'LEX'").collect()
    expected = Counter()
    for w in vocabulary:
        for _, e, m, category in lexicon:
            if m == "FM" and w == e or m == "M" and re.match(e, w) or m == "C" and re.search(e, w):
                expected[category] += 1
    assert {r["word"]: r["count"] for r in got} == expected


def test_dictionary_holds_changed_words_only(spark):
    rows = [(i, "EN", "PROPN", w, 1) for i, w in enumerate(["North-East", "Plain", "Plain", "x1", "North-East"])]
    df = spark.createDataFrame(rows, "text_id long, language string, type string, word string, count long")
    found = index.rewrite_dictionary(df, ["[0-9]"], {"-": " ", r"(N)(\w+)": r"\2\1"})
    assert {tuple(r) for r in found.collect()} == {
        ("North-East", "orthN East", None, r"(N)(\w+)"),
        ("x1", "x1", "[0-9]", None),
    }


def test_many_patterns_one_plan(spark):
    """A thousand patterns: the plan does not grow with them."""
    df = spark.createDataFrame([(1, "EN", "PROPN", "w7-w8", 2)], "text_id long, language string, type string, word string, count long")
    replace = {f"w{n}": f"v{n}" for n in range(1000)}
    data, changes = index.clean_words(df, ["zz"] * 1000, replace)
    assert [tuple(r) for r in data.collect()] == [(1, "EN", "PROPN", "v7-v8", 2)]
    assert [tuple(r) for r in changes.collect()] == [("w7-w8", "v7-v8", None, "w8")]
