import datetime
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import wordloom as wl
from checks import queries
from wordloom import schemas
from wordloom.schemas import WORD_FREQUENCY
from wordloom.sources import json_arrays, readers, writers

from .conftest import rows


def test_article_array_files(spark, tmp_path):
    old = {"media": "FAZ", "date": "2020-03-18", "hash_text": -5, "title": "t", "rubrics": "r", "url": "u", "paywall": False, "text": "äöü"}
    new = {**old, "text_id": 7, "rubric": "q", "text": "x"}
    (tmp_path / "a.json").write_text(json.dumps([old, old]))
    (tmp_path / "b.json").write_text(json.dumps([new]))
    (tmp_path / "c.json").write_text("[{broken")
    (tmp_path / "d.json").write_bytes(b"[{\"text\": \"\xff\"}]")
    got, rejects = readers.read_article_files(spark, str(tmp_path))
    reasons = [(r["file"][-6:], r["reject_reason"]) for r in rejects.orderBy("file").collect()]
    assert reasons == [("c.json", "malformed JSON"), ("d.json", "not UTF-8")]
    assert rows(got, "text_id", "rubric", "num_characters", "date") == [
        (-5, "r", 3, datetime.date(2020, 3, 18)),
        (-5, "r", 3, datetime.date(2020, 3, 18)),
        (7, "q", 1, datetime.date(2020, 3, 18)),
    ]
    assert got.columns == schemas.ARTICLES.names


def test_article_files_do_not_grow_with_a_source(spark, tmp_path, monkeypatch):
    """A source that holds most of the rows, all with one id or none, makes many files of a bounded size."""
    docs = [(1 if n % 2 else None, "hot", f"{n} " + "x" * 1000) for n in range(400)] + [(n, "src7", "y" * 1000) for n in range(100)]
    spark.createDataFrame([*docs, (5, None, None)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "ARTICLE_FILE_BYTES", 20_000, raising=False)
    got = queries.article_files(spark, str(tmp_path))
    sizes = [len(Path(f.removeprefix("file:")).read_bytes()) for f in got.inputFiles()]
    assert len(sizes) > 20 and max(sizes) < 60_000
    hot = sorted(r.text for r in got.where("media = 'hot'").collect())
    assert hot == sorted(d[2] for d in docs if d[1] == "hot")
    assert got.count() == 401
    assert rows(queries.article_file_rejects(spark, str(tmp_path))) == [("src7", "malformed JSON")]


def test_csv_forms(spark, tmp_path):
    (tmp_path / "words.csv").write_text("text_id,language,type,word,count\n1,DE,PROPN,Grüße,3\n2,DE,PROPN,b,1\n")
    (tmp_path / "docs.tsv").write_text("text_id\tlanguage\ttext\n1\tDE\ta b\n")
    (tmp_path / "freq.csv").write_text("2020-03-18,DE,PROPN,a,3\n")
    (tmp_path / "black.txt").write_text("Jahr\nProzent,egal\n\nJahr\n")
    (tmp_path / "wide.csv").write_text("keyword,DE,FR\nCorona,Corona*,\n")
    base = str(tmp_path)
    words = readers.read_csv(spark, f"{base}/words.csv", schemas.TEXT_WORDS, columns=["word"], limit=1)
    assert rows(words) == [("Grüße",)]
    docs = readers.read_csv(spark, f"{base}/docs.tsv", schemas.DOCS, sep="\t")
    assert rows(docs) == [(1, "DE", "a b")]
    freq = readers.read_word_frequency(spark, f"{base}/freq.csv")
    assert rows(freq) == [(datetime.date(2020, 3, 18), "DE", "PROPN", "a", 3)]
    assert rows(readers.read_blacklist(spark, f"{base}/black.txt")) == [("Jahr",), ("Jahr",), ("Prozent",)]
    assert rows(readers.read_wide_lexicon(spark, f"{base}/wide.csv", ["DE", "FR"])) == [("Corona", "Corona*", None)]


def test_topics_csv_by_position(spark, tmp_path):
    head = "TOPIC,LANGUAGE,TYPE,DATE,EXPIRY_DATE,ATTRIBUTE,KEYWORD_1,KEYWORD_2\n"
    (tmp_path / "t.csv").write_text(head + "2031-07-09-4,FR,ALGO,2031-07-09,,,Brume,Rivage\n")
    got = readers.read_topics(spark, f"{tmp_path}/t.csv", 2).first()
    assert (got["topic"], got["date"], got["keyword_2"]) == ("2031-07-09-4", datetime.date(2031, 7, 9), "Rivage")


def test_csv_and_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "DE", "PROPN", "Grüße, \"du\"", 3)], schemas.TEXT_WORDS)
    writers.write_csv(df, f"{tmp_path}/csv")
    assert rows(readers.read_csv(spark, f"{tmp_path}/csv", schemas.TEXT_WORDS)) == rows(df)
    writers.write_json(df, f"{tmp_path}/json")
    text = spark.read.text(f"{tmp_path}/json").first()[0]
    assert "Grüße" in text
    assert rows(spark.read.schema(schemas.TEXT_WORDS).json(f"{tmp_path}/json")) == rows(df)


def test_catalog_tables(spark):
    for table in writers.TABLES:
        writers.create_table(spark, table)
        writers.create_table(spark, table)
    data = [(1, "DE", "PROPN", "w" * 100, 3), (2, "FR", "PROPN", "x", 1)]
    df = spark.createDataFrame(data, schemas.TEXT_WORDS)
    writers.append_table(df, "text_words")
    writers.append_table(df.limit(1), "text_words")
    got = readers.read_table(spark, "text_words")
    assert rows(got, *schemas.TEXT_WORDS.names) == [
        (1, "DE", "PROPN", "w" * 100, 3), (1, "DE", "PROPN", "w" * 100, 3), (2, "FR", "PROPN", "x", 1),
    ]
    assert rows(writers.key_duplicates(got, "text_words")) == [(3, 1)]
    assert rows(schemas.values_to_cut(got, "text_words")) == [("language", 0), ("type", 0), ("word", 2)]
    assert rows(schemas.fit_widths(got, "text_words"), "word", "count") == [("w" * 80, 6), ("x", 1)]
    day = datetime.date(2020, 3, 18)
    freq = spark.createDataFrame([(day, "DE", "PROPN", "a", 3)], schemas.WORD_FREQUENCY)
    writers.append_table(freq, "word_frequency")
    plan = spark.table("word_frequency").where("date = date'2020-03-18'")
    assert "PartitionFilters: [isnotnull(date" in plan._jdf.queryExecution().executedPlan().toString()
    for table in writers.TABLES:
        spark.sql(f"DROP TABLE {table}")


def test_partitioned_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "DE", "PROPN", "a", 3), (2, "FR", "PROPN", "x", 1)], schemas.TEXT_WORDS)
    writers.write_parquet(df, f"{tmp_path}/w", "text_words")
    writers.write_parquet(df, f"{tmp_path}/w", "text_words")
    assert sorted(p.name for p in (tmp_path / "w").glob("language=*")) == ["language=DE", "language=FR"]
    assert spark.read.parquet(f"{tmp_path}/w").count() == 4


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "daily")

    def day(number, *counts):
        data = [(datetime.date(2020, 3, number), "EN", "PROPN", w, n) for w, n in counts]
        return spark.createDataFrame(data, "date date, language string, type string, word string, count long")

    writers.replace_partitions(day(1, ("a", 1)).union(day(2, ("a", 2), ("b", 3))), path, "word_frequency")
    for _ in range(2):
        writers.replace_partitions(day(2, ("c", 4)).union(day(3, ("d", 5))), path, "word_frequency")
    stored = spark.read.schema(WORD_FREQUENCY).parquet(path)
    assert sorted((r["date"].day, r["word"], r["count"]) for r in stored.collect()) == [(1, "a", 1), (2, "c", 4), (3, "d", 5)]


def test_daily_frequencies_of_deliveries(spark, tmp_path):
    path = str(tmp_path / "daily")
    index = spark.createDataFrame(
        [(n, "EN", "PROPN", w, 1) for n, w in ((1, "a"), (2, "a"), (3, "b"), (4, "a"))],
        "text_id long, language string, type string, word string, count long",
    )
    dates = {1: 1, 2: 1, 3: 2, 4: 1}

    def metadata(*ids):
        data = [(n, datetime.date(2020, 3, dates[n])) for n in ids]
        return spark.createDataFrame(data, "text_id long, date date")

    def deliver(known, *new):
        wl.update_daily_frequency(index, metadata(*known), spark.createDataFrame([(n,) for n in new], "text_id long"), path)
        stored = spark.read.schema(WORD_FREQUENCY).parquet(path)
        return sorted((r["date"].day, r["word"], r["count"]) for r in stored.collect())

    assert deliver([1, 2], 1, 2) == [(1, "a", 2)]
    assert deliver([1, 2], 1, 2) == [(1, "a", 2)]
    assert deliver([1, 2, 3], 3) == [(1, "a", 2), (2, "b", 1)]
    assert deliver([1, 2, 3, 4], 4) == [(1, "a", 3), (2, "b", 1)]


@pytest.mark.parametrize("width", ["97b", "1000b", "10m"])
def test_arrays_split_over_ranges(spark, tmp_path, width):
    """Braces, quotes and backslashes in strings, nested objects, blanks: whatever the ranges, the same records."""
    rng = random.Random(6)
    pieces = ["{", "}", '"', "\\", "[", "]", ",", "a", "é", " ", "\n", "},{", "\\\\", '\\"', "日本"]
    wanted = []
    for n in range(4):
        some = []
        for k in range(rng.randint(0, 40)):
            record = {"n": n * 100 + k, "text": "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))}
            if rng.random() < 0.4:
                record["more"] = {"{": [{"x": "}"}], "y": {"z": {}}}
            some.append(record)
        text = json.dumps(some, ensure_ascii=n % 2 == 0, indent=2 if n == 3 else None)
        (tmp_path / f"{n}.json").write_text(" " * n + text + "\n" * n)
        wanted += [(r["n"], r["text"]) for r in some]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    try:
        records = json_arrays.json_array_records(spark, str(tmp_path))
        good, bad = json_arrays.parse_records(records, StructType.fromDDL("n long, text string"))
        assert sorted(tuple(r) for r in good.collect()) == sorted(wanted)
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_arrays_lose_one_record(spark, tmp_path):
    whole = json.dumps([{"n": k, "text": f"t{k}"} for k in range(5)])
    (tmp_path / "a.json").write_text(whole[:-1])  # only the bracket lacks
    (tmp_path / "b.json").write_text(whole[:-2])  # the last record is open
    (tmp_path / "c.json").write_text(whole.replace('"t2"', '"t2'))  # a quote lacks
    (tmp_path / "d.json").write_bytes(whole.encode().replace(b"t3", b"t\xff"))
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "f.json").write_text('{"n": 1, "text": "no array"}')
    records = json_arrays.json_array_records(spark, str(tmp_path))
    good, bad = json_arrays.parse_records(records, StructType.fromDDL("n long, text string"))
    name = F.regexp_extract("file", r"(\w)\.json", 1)
    got = Counter(r[0] for r in records.where("whole").select(name).collect())
    assert (got["a"], got["b"], got["d"], got["e"], got["f"]) == (5, 4, 5, 0, 0)
    rejected = {(r[0], r[1]) for r in bad.select(name, "reject_reason").collect()}
    assert rejected == {("b", "malformed JSON"), ("c", "malformed JSON"), ("d", "not UTF-8"), ("f", "malformed JSON")}
    assert good.where("text = 't4'").count() == 2 and good.where("text = 't0'").count() == 4
