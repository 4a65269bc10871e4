import datetime
import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import wordloom as wl
from checks import queries
from wordloom.sources.readers import read_article_lines
from wordloom.streaming.articles import dedupe_stream, start_ingest, stream_articles
from wordloom.streaming.log import BatchLog
from wordloom.streaming.memory import IdMemory
from wordloom.streaming.words import (
    current_rows,
    daily_counts,
    latest_rows,
    start_append,
    start_current,
    start_operator,
    start_updates,
)

from .conftest import rows
from .test_articles_pages import LINE


def land(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def test_ingest_in_batches_equals_batch(spark, tmp_path):
    landing = tmp_path / "lines"
    out = [str(tmp_path / n) for n in ("articles", "rejects", "checkpoint")]
    a, b, c = ({**LINE, "text": t} for t in "abc")
    land(landing, "1.json", a, a, b, "{broken")

    def run():
        lines = read_article_lines(spark, str(landing), streaming=True)
        start_ingest(lines, "FAZ", "2020-03-18", *out).awaitTermination()

    run()
    land(landing, "2.json", b, c, {"text": "x"})
    run()
    run()
    articles, rejects = wl.ingest_articles(read_article_lines(spark, str(landing)), "FAZ", "2020-03-18")
    assert rows(spark.read.parquet(out[0]).drop("batch")) == rows(articles)
    assert rows(spark.read.parquet(out[1]).drop("batch")) == rows(rejects)
    assert articles.count() == 3 and rejects.count() == 2


def test_stream_of_articles_remembers_ids(spark, tmp_path):
    landing = tmp_path / "lines"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for n, texts in enumerate(["aab", "bc"]):
        land(landing, f"{n}.json", *({**LINE, "text": t} for t in texts))
        lines = spark.readStream.text(str(landing))
        start_append(stream_articles(lines, "FAZ", "2020-03-18"), out, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(out), "text") == [("a",), ("b",), ("c",)]


def test_bounded_memory_of_ids(spark, tmp_path):
    schema = "text_id long, at timestamp"
    stamp = datetime.datetime(2020, 3, 18)
    data = [(n % 3, stamp + datetime.timedelta(minutes=n)) for n in range(9)]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    once = dedupe_stream(stream, event_time="at", horizon="1 hour")
    start_append(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "text_id") == [(0,), (1,), (2,)]


WORDS = "at timestamp, language string, type string, word string, count int"


def test_daily_counts_stream_and_batch(spark, tmp_path):
    start = datetime.datetime(2020, 3, 18)
    data = [
        (start + datetime.timedelta(hours=h), "DE", "PROPN", f"w{h % 2}", 1) for h in range(0, 100, 5)
    ]
    df = spark.createDataFrame(data, WORDS)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    expected = rows(daily_counts(df, "at"))
    stream = spark.readStream.schema(WORDS).parquet(str(tmp_path / "in"))
    late = spark.readStream.schema(WORDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_updates(daily_counts(late, "at", "9 days"), str(tmp_path / "all"), str(tmp_path / "cp1")).awaitTermination()
    updates = spark.read.parquet(str(tmp_path / "all"))
    assert updates.select("batch").distinct().count() > 1
    assert rows(latest_rows(updates, ["date", "language", "type", "word"])) == expected
    start_append(daily_counts(stream, "at"), str(tmp_path / "done"), str(tmp_path / "cp2")).awaitTermination()
    done = rows(spark.read.parquet(str(tmp_path / "done")))
    assert done and set(done) < set(expected)


def test_operator_per_batch_reads_current_list(spark, tmp_path):
    words = "text_id long, language string, type string, word string, count int"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    listed = ["a"]

    def operator(batch):
        return wl.remove_blacklisted(batch, listed)

    for n in range(2):
        data = [(n, "DE", "PROPN", w, 1) for w in "abc"]
        spark.createDataFrame(data, words).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(words).parquet(folder)
        start_operator(stream, operator, out, checkpoint, document_id=None).awaitTermination()
        listed.append("b")
    assert rows(spark.read.parquet(out), "text_id", "word") == [(0, "b"), (0, "c"), (1, "c")]


def test_documents_count_once_over_batches(spark, tmp_path):
    schema = "text_id long, language string, text string"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for ids in ((1, 2), (2, 3), (1,)):
        data = [(i, "DE", "Haus") for i in ids]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        start_operator(stream, wl.extract_words, out, checkpoint, document_id="text_id").awaitTermination()
    assert rows(spark.read.parquet(out), "text_id", "word", "count") == [(n, "Haus", 1) for n in (1, 2, 3)]


def test_row_operators_on_a_stream(spark, tmp_path):
    words = "text_id long, language string, type string, word string, count int"
    spark.createDataFrame([(1, "DE", "PROPN", w, 1) for w in "ab"], words).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(words).parquet(str(tmp_path / "in"))
    kept = wl.remove_blacklisted(stream, ["a"])
    start_append(kept, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "word") == [("b",)]


def test_log_of_batches_and_bases(spark, tmp_path):
    schema = StructType.fromDDL("day int, n int")
    log = BatchLog(spark, str(tmp_path / "log"), schema, "day", create=True)

    def put(batch, *data):
        log.write(spark.createDataFrame(list(data), schema), batch)

    def largest(stored):
        return stored.groupBy("day").agg(F.max("n").alias("n"))

    put(0, (1, 10), (2, 20))
    put(1, (1, 11))
    assert rows(log.read(), "day", "n", "batch") == [(1, 10, 0), (1, 11, 1), (2, 20, 0)]
    log.compact(1, largest)
    assert log.compacted() == 1 and log.newer().count() == 0
    assert rows(log.read(), "day", "n") == [(1, 11), (2, 20)]
    put(2, (2, 21), (3, 30))
    put(2, (2, 22), (3, 30))  # the batch runs again
    log.compact(2, largest)
    log.compact(2, largest)
    put(3, (1, 9))
    reader = BatchLog(spark, str(tmp_path / "log"), schema, "day")
    assert rows(reader.read(), "day", "n", "batch") == [(1, 9, 3), (1, 11, 2), (2, 22, 2), (3, 30, 2)]
    assert rows(reader.read(before=3, only=[1, 3]), "day", "n") == [(1, 11), (3, 30)]
    # Only the days that batch 2 touched were written again.
    written = [f for f in reader.base().inputFiles() if "through=2" in f]
    assert written and all("day=2" in f or "day=3" in f for f in written)


def test_base_without_mark_is_not_read(spark, tmp_path):
    schema = StructType.fromDDL("day int, n int")
    log = BatchLog(spark, str(tmp_path / "log"), schema, "day", create=True)
    log.write(spark.createDataFrame([(1, 1)], schema), 0)
    spark.createDataFrame([(1, 99)], schema).write.partitionBy("day").parquet(f"{tmp_path}/log-base/through=0")
    assert rows(log.read(), "day", "n") == [(1, 1)]


def test_memory_of_ids(spark, tmp_path):
    """Twenty batches of new ids: however many are stored, a batch of new ids reads next to none of them."""
    memory = IdMemory(spark, str(tmp_path / "ids"), buckets=64)

    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "text_id long")

    read = []
    for batch in range(20):
        new = list(range(batch * 200, batch * 200 + 200))
        assert memory.unseen(ids(*new[:20], None), batch).count() == 21
        maybe = memory.maybe_known(ids(*new[:20]), batch)
        read.append(maybe.select("bucket").distinct().count())
        memory.remember(ids(*new, new[0], None), batch)
        if batch == 11:
            memory.compact(batch - 1)
            assert memory.ids.compacted() == 10
    assert sum(read) <= 20 and max(read[10:]) <= 5  # of 64 buckets, where the filter errs
    again = memory.unseen(ids(3, 1999, 4000, 3999, -7), 20)
    assert rows(again) == [(-7,), (4000,)]
    # A batch that runs again does not meet its own ids.
    assert memory.unseen(ids(*range(3800, 3810)), 19).count() == 10
    assert {r["bucket"] for r in memory.ids.read(20, [1, 2]).select("bucket").collect()} <= {1, 2}


def test_ingest_compacts_and_counts(spark, tmp_path):
    landing = tmp_path / "lines"
    out = [str(tmp_path / n) for n in ("articles", "rejects", "checkpoint")]
    texts = ["ab", "bc", "ca", "dd", "ae", "fa"]
    for n, letters in enumerate(texts):
        land(landing, f"{n}.json", *({**LINE, "text": t} for t in letters), "{broken")
        lines = read_article_lines(spark, str(landing), streaming=True)
        start_ingest(
            lines, "FAZ", "2020-03-18", *out, counts_path=str(tmp_path / "counts"), buckets=4, compact_every=2
        ).awaitTermination()
    assert rows(spark.read.parquet(out[0]), "text") == [(t,) for t in "abcdef"]
    counts = rows(spark.read.parquet(str(tmp_path / "counts")), "batch", "lines", "rejected", "repeated", "articles")
    assert counts == [(0, 3, 1, 0, 2), (1, 3, 1, 1, 1), (2, 3, 1, 2, 0), (3, 3, 1, 1, 1), (4, 3, 1, 1, 1), (5, 3, 1, 1, 1)]


def test_current_rows_with_bases(spark, tmp_path):
    landing = tmp_path / "in"
    schema = "ts timestamp, language string, type string, word string, count long"
    keys = ["date", "language", "type", "word"]
    stamps = [datetime.datetime(2020, 3, 1 + n % 3, 12) for n in range(10)]
    for n in range(5):
        data = [(t, "EN", "T", "w", 1) for t in stamps[: n + 2]]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(landing))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(landing))
        counts = daily_counts(stream, "ts", "60 days")
        start_current(counts, str(tmp_path / "out"), str(tmp_path / "cp"), keys, compact_every=2).awaitTermination()
    expected = daily_counts(spark.read.schema(schema).parquet(str(landing)), "ts")
    got = current_rows(spark, str(tmp_path / "out"), counts.schema, keys)
    assert rows(got, *keys, "count") == rows(expected, *keys, "count")
    log = BatchLog(spark, str(tmp_path / "out"), counts.select(*keys, "count").schema, "date")
    assert log.compacted() >= 1


def test_batches_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    """Tables that land in many files are a batch each, whatever their size; the rows are those of one batch."""
    docs = spark.range(240).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Paris The word"), F.col("id") % 50, F.repeat(F.lit(" more"), 20)).alias("text"),
        F.lit("en").alias("lang"), F.lit("src1").alias("source"),
    )
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "_stream_paths", lambda spark, name: (f"{tmp_path}/s", f"{tmp_path}/s/checkpoint"))
    got = queries.stream_remove_blacklisted(spark, str(tmp_path))
    assert len([p for p in (tmp_path / "s/in").iterdir() if p.suffix == ".parquet"]) >= 8
    assert sorted(p.name for p in (tmp_path / "s/checkpoint/offsets").iterdir() if p.name.isdigit()) == ["0", "1", "2", "3"]
    assert rows(got) == rows(queries.remove_blacklisted(spark, str(tmp_path)))
