"""What only shows on larger tables, at a small size."""

import re
import time
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import wordloom as wl
from checks import queries
from wordloom.functions import frames, joins, regex, workdir
from wordloom.llm import ngrams, words
from wordloom.operators import index, words as words_of
from wordloom.sources import writers

from .conftest import rows


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_an_array_is_one_file_when_the_join_was_planned_as_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ARRAY_DOCS", 50)
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"),
        F.lit("src1").alias("source"),
    )
    docs.repartitionByRange(8, F.pmod(F.col("doc_id"), F.lit(8))).write.parquet(f"{tmp_path}/documents.parquet")
    # Planned as a shuffled join, and found to be small enough for a broadcast as it runs.
    confs = {
        "spark__sql__autoBroadcastJoinThreshold": "1000",
        "spark__sql__shuffle__partitions": "8",
        "spark__sql__files__maxPartitionBytes": "3k",
        "spark__sql__files__openCostInBytes": "3k",
    }
    with settings(spark, **confs):
        assert rows(queries.article_array_rejects(spark, str(tmp_path))) == [("malformed JSON", 399)]
        assert queries.article_arrays(spark, str(tmp_path)).count() == 399


def test_texts_are_dealt_by_their_bytes(spark, monkeypatch):
    """Tasks that count words get a share of the text that does not grow with it; many copies of an id go before."""
    monkeypatch.setattr(frames, "TEXT_BYTES_PER_TASK", 2000)
    docs = spark.range(400).select(F.col("id").alias("text_id"), F.lit("EN").alias("language"), F.repeat(F.lit("word "), 20).alias("text"))
    copies = spark.range(100).select(
        F.when(F.col("id") % 2 == 0, 7).cast("long").alias("text_id"), F.lit("EN").alias("language"),
        F.concat(F.lit("aa"), F.repeat(F.lit("x"), 99)).alias("text"),
    )
    prepared = wl.prepare_docs(docs.unionByName(copies))
    assert prepared.rdd.getNumPartitions() >= 400 * 100 // 2000
    found = {r["text_id"]: r["text"][:4] for r in prepared.collect()}
    assert prepared.count() == 401 and found == {**dict.fromkeys(range(400), "word"), 7: "aaxx", None: "aaxx"}


def test_rows_of_words_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(frames, "WORD_ROWS_PER_TASK", 50)
    words = spark.range(1000).select(
        F.col("id").alias("text_id"), F.lit("EN").alias("language"), F.lit("PROPN").alias("type"),
        F.lit("a1").alias("word"), F.lit(2).cast("long").alias("count"),
    )
    cleaned, _ = wl.clean_words(words.unionByName(words), replace={"1": "b"})
    assert cleaned.rdd.getNumPartitions() >= 20
    assert rows(cleaned, "text_id", "word", "count") == [(n, "ab", 4) for n in range(1000)]


def test_rows_of_a_trend_are_dealt_by_their_number(spark, monkeypatch):
    """Whatever the session's partitions, a task has a share of the days read; many words that become one, too."""
    freq = spark.range(3000).select(
        F.expr("date_add(date'2024-01-01', cast(id % 10 as int))").alias("date"), F.lit("EN").alias("language"),
        F.lit("PROPN").alias("type"), F.concat(F.lit("w"), F.floor(F.col("id") / 10) % 150).alias("word"), (F.col("id") % 10 + 1).alias("count"),
    )
    merge = {"all": [f"w{n}" for n in range(100)]}
    lexicon = spark.createDataFrame([("EN", "w1", "M", "one")], "language string, word string, mapping string, category string")
    options = [{}, {"merge": merge}, {"lexicon": lexicon}, {"top_n": 40, "merge": merge}, {"rank_by_language": True}]

    def trends():
        return [wl.word_trend(freq, periods=[3, 7], top_ratio=1.0, **o) for o in options]

    def found_in(trend):  # the order of the days moves the last digit
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(trend)]

    expected = [found_in(t) for t in trends()]
    assert [len(e) for e in expected] == [150, 51, 90, 40, 150]
    assert [e[:5] for e in expected[1] if e[2] == "all"] == [(expected[0][0][0], "EN", "all", 2000, 1)]
    monkeypatch.setattr(frames, "WORD_ROWS_PER_TASK", 50)
    for found, wanted in zip(trends(), expected, strict=True):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*word#[^\]]*\], (\d+)", plan)]
        assert max(dealt, default=0) >= 3000 * 7 // 10 // 50
        assert found_in(found) == wanted


def test_equal_lexicon_rows_are_one_rule_and_count_each(spark):
    """Patterns bound to an end meet only the words that have it."""
    vocabulary = [a + b + c for a in ("abc", "abd", "xyz") for b in ("", "mno", "qrs") for c in ("abc", "tuv", "tuv\n")]
    df = spark.createDataFrame([(1, "EN", "PROPN", w, 3) for w in vocabulary], "text_id long, language string, type string, word string, count long")
    entries = [("abc.*tuv$", "C"), ("^abd", "C"), ("abc.no", "M"), ("xyz$", "C"), (r"mno\w*uv\Z", "C"), ("^(?:abc)?tuv|xyz$", "C")]
    lexicon = [("EN", e, m, c) for e, m in entries for c in ("one", "two", "two")]
    table = spark.createDataFrame(lexicon, "language string, word string, mapping string, category string")
    rules = index.lexicon_rules(table)
    assert rules.count() == len(entries)
    pairs = index.lexicon_candidates(df.select("word"), rules)
    assert {r["word"] for r in pairs.where("entry = 'abc.*tuv$'").collect()} <= {w for w in vocabulary if w.rstrip().endswith("tuv")}
    n = sum(bool((re.match if m == "M" else re.search)(e, w)) for e, m in entries for w in vocabulary)
    got = wl.map_lexicon(df, table).where("type = 'LEX'")
    assert rows(got, "word", "count") == [("one", 3 * n), ("two", 6 * n)]
    once = wl.map_lexicon(df, table, once_per_category=True).where("type = 'LEX'")
    held = sum(any((re.match if m == "M" else re.search)(e, w) for e, m in entries) for w in vocabulary)
    assert rows(once, "word", "count") == [("one", 3 * held), ("two", 3 * held)]


def test_anchors():
    assert regex.anchors("abc.*xyz$") == ("", "xyz")
    assert regex.anchors("abc.d", True) == ("abc", "")
    assert regex.anchors("^ab|cd$") == regex.anchors("(?i)^ab") == regex.anchors("(?m)ab$") == regex.anchors("(") == ("", "")
    assert regex.anchors("^abc$") == ("abc", "abc")
    assert regex.anchors("^abc?$") == ("ab", "")


def test_positions_are_held_against_the_beginnings_before_they_move(spark, monkeypatch):
    """Of many positions few are joined by a shuffle, also where hashes of the map collide; phrases stay the same."""
    docs = spark.range(50).select(
        F.col("id").alias("text_id"), F.lit("EN").alias("language"),
        F.concat_ws(" ", F.lit("New York City and"), F.expr("array_join(transform(sequence(1, 40), x -> concat('w', x, 'x', id)), ' ')"), F.lit("Rio Bravo")).alias("text"),
    )
    phrases = [("EN", "New York City", "LOC"), ("EN", "New York", "LOC"), ("DE", "Rio Bravo", "LOC"), ("EN", "and w1x7 w2x7", "ORG")]
    gazetteer = spark.createDataFrame(phrases, "language string, phrase string, label string")
    trie = words_of.phrase_trie(gazetteer)
    ahead = F.expr("transform(sequence(1, 45), i -> slice(split(text, ' '), i, 3))")
    positions = docs.select("text_id", "language", F.explode(ahead).alias("ahead"))
    assert words_of._maybe_begins(positions, trie).count() <= 50 + 50 + 1
    expected = rows(words_of.count_phrases(docs, gazetteer, broadcast=True))
    for bits in (1 << 26, 64, 1):
        monkeypatch.setattr(words_of, "_MAP_BITS", bits)
        assert rows(words_of.count_phrases(docs, gazetteer, broadcast=False)) == expected


def test_a_settled_table_leaves_no_shuffle_files(spark):
    """What a job shuffled is gone when its table is stored; the setting is as before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shuffled = lambda: sum(disk.getAllFiles().apply(n).getName().startswith("shuffle_") for n in range(disk.getAllFiles().size()))
    before = shuffled(), spark.conf.get(name)
    table = workdir.settle(spark.range(1000).groupBy((F.col("id") % 7).alias("a")).count())
    for _ in range(50):
        if shuffled() <= before[0]:
            break
        time.sleep(0.1)
    assert shuffled() <= before[0] and spark.conf.get(name) == before[1]
    assert rows(table) == [(n, 143 if n < 6 else 142) for n in range(7)]


def test_what_texts_ask_for_is_stored_short():
    """Six bytes an n-gram, in the order of its bucket; places and levels column by column."""
    grams = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    stored = ngrams.short_keys(grams).tobytes()
    assert len(stored) == 6 * len(grams)
    assert (ngrams.from_short(stored) == grams >> np.uint64(16)).all() and len(ngrams.from_short(b"")) == 0
    assert (ngrams.from_short(stored) % np.uint64(64) == ngrams.bucket_of(grams, 64)).all()
    places = np.arange(7, dtype="<u4").view(np.uint8).reshape(-1, 4)
    assert ngrams.planes(places) == bytes(range(7)) + bytes(21)
    assert (ngrams.from_planes(ngrams.planes(places), 4) == places).all() and ngrams.from_planes(b"", 3).shape == (0, 3)


def last_plan(spark):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return runs.apply(runs.size() - 1).physicalPlanDescription()


def test_rows_are_written_by_value_without_a_sort(spark, tmp_path):
    """A task does not hold its rows to sort them; beyond the files it keeps open the rest is sorted. Values are whole."""
    words = spark.range(400).select(
        F.col("id").alias("text_id"), F.concat(F.lit("L"), F.col("id") % 40).alias("language"), F.lit("PROPN").alias("type"),
        F.concat(F.lit("w"), "id").alias("word"), F.lit(2).alias("count"),
    ).repartition(3)
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    writers.write_parquet(words, f"{tmp_path}/words", "text_words")
    writers.write_parquet(words, f"{tmp_path}/words", "text_words")
    assert "Sort" not in last_plan(spark)
    assert spark.conf.get(name, None) == before
    stored = spark.read.parquet(f"{tmp_path}/words")
    expected = sorted(2 * [(n, f"L{n % 40}", f"w{n}", 2) for n in range(400)])
    assert rows(stored, "text_id", "language", "word", "count") == expected
    daily = stored.groupBy(F.expr("date_add(date'2024-01-01', cast(text_id % 9 as int))").alias("date"), "language", "type", "word").agg(F.sum("count").alias("count"))
    writers.replace_partitions(daily, f"{tmp_path}/daily", "word_frequency")
    writers.replace_partitions(daily.where("date < '2024-01-03'"), f"{tmp_path}/daily", "word_frequency")
    assert "Sort" not in last_plan(spark)
    assert spark.read.parquet(f"{tmp_path}/daily").agg(F.sum("count")).first()[0] == 1600


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """What packing reads of texts comes in batches far below Spark's own bound, and all of it."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    found = workdir.settle(docs.mapInArrow(words.released(sizes), "n long, bytes long"), "sizes", workdir.TEXT_BATCHES)
    assert spark.conf.get(name) == before
    got = found.agg(F.sum("n"), F.max("bytes")).first()
    assert got[0] == 400 and got[1] < 13 << 20


def test_a_worker_gives_back_what_it_does_not_use():
    """Free memory of Arrow's pool does not stay with the worker when its task is through."""
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) >> 10

    def some(batches):
        held = [pa.array(range(200_000)) for _ in batches]
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])

    assert [b.to_pydict() for b in words.released(some)(iter(range(50)))] == [{"n": [50]}]
    at = resident()
    pa.default_memory_pool().release_unused()
    assert at - resident() < 20


def test_a_lexicon_is_broadcast_by_the_size_of_its_hash_table(spark, monkeypatch):
    """Rows of short words take several times their letters on the driver; a list beyond the bound is shuffled."""
    words = [f"w{n:03}x" for n in range(400)]
    df = spark.createDataFrame([(n, "EN", "PROPN", w, 2) for n, w in enumerate(words)], "text_id long, language string, type string, word string, count long")
    rules = [("EN", w, ("FM", "M", "C")[n % 3], "abc"[n % 2]) for n, w in enumerate(words)]
    lexicon = spark.createDataFrame(rules, "language string, word string, mapping string, category string")
    plans = {}

    def settled(table, name="table", *args):
        plans[name] = table._jdf.queryExecution().executedPlan().toString()
        return workdir.settle(table, name, *args)

    monkeypatch.setattr(index, "settle", settled)
    for most, broadcast in ((1 << 20, True), (50_000, False)):  # 400 rows: 20 KB of fields, 70 KB of hash table
        monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", most)
        with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
            got = wl.map_lexicon(df, lexicon).where("type = 'LEX'")
            assert rows(got, "word", "count") == [("ab"[n % 2], 2) for n in sorted(range(400), key=lambda n: n % 2)]
        assert ("Broadcast" in plans["lexicon-hits"]) == broadcast


def test_words_stay_with_their_document_beside_a_shuffled_list(spark, monkeypatch):
    """Words are counted without a shuffle, and frequent ones are annotated without one; no step leaves shuffle files."""
    docs = spark.range(60).select(
        F.col("id").alias("text_id"), F.lit("EN").alias("language"),
        F.concat(F.lit("New York City and Rio Bravo and Rio again w"), F.col("id") % 7).alias("text"),
    )
    phrases = [("EN", "New York City", "LOC"), ("EN", "New York", "LOC"), ("EN", "New York", "ORG"), ("EN", "Rio", "PER"), ("DE", "Rio Bravo", "LOC")]
    gazetteer = spark.createDataFrame(phrases, "language string, phrase string, label string")
    surfaces = [("EN", "Rio", "rio", "NOUN"), ("EN", "again", "Again", "NOUN"), ("EN", "York", "york", "X")]
    annotations = spark.createDataFrame(surfaces, "language string, surface string, lemma string, pos string")
    dealt = wl.prepare_docs(docs)
    counted, found = words_of._counted(dealt, gazetteer, False)
    assert "ENSURE_REQUIREMENTS" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {r["phrase"] for r in found.collect()} == {"New York City", "New York"}
    expected = rows(wl.extract_words(dealt, annotations, gazetteer, broadcast=True))
    assert len(expected) == 60 * 9
    assert rows(wl.extract_words(dealt, annotations, gazetteer, broadcast=False)) == expected
    moved = {}

    def settled(table, name="table", *args):
        stored = workdir.settle(table, name, *args)
        moved[name] = table._jdf.queryExecution().optimizedPlan().toString()
        return stored

    monkeypatch.setattr(words_of, "settle", settled)
    for hot in (0, 3, 10_000):
        monkeypatch.setattr(words_of, "HOT_KEYS", hot)
        assert rows(wl.extract_words(dealt, annotations, gazetteer, broadcast=False)) == expected
    assert {"document-words", "document-phrases", "document-entities", "typed-words"} <= set(moved)
    assert "LeftAnti" in moved["typed-words"]
