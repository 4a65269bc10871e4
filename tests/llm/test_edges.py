"""NULLs, empty and long texts, ties, repeated rows, empty tables and extra columns for every operator."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm import crf, exact, mixing, near, ngrams, packing, resampling, search, tokenfiles, toxicity, warc
from wordloom.llm.graph import connected_components
from wordloom.llm.tokens import END_ID, Encoder, default_path

SCHEMA = "doc_id long, text string, source string, n int, sid long, gid long, key long, size long, bucket int, place int, component_id long, __id long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat again and again until noon", "a"),
    (2, "the cat sat on the mat again and again until noon", "a"),
    (2, "the cat sat on the mat again and again until noon", "a"),  # a repeated row
    (3, "the cat sat on the mat again and again until noon today", "b"),
    (4, None, None),
    (5, "", "a"),
    (6, " \t\n ", None),
    (7, "one", "b"),
    (8, LONG, "b"),
    (9, LONG + " end", "c"),
    (None, "no id but words enough for a set here", "c"),
    (None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8, 9) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(rows_of(connected_components(spark.createDataFrame(path, "a long, b long")), "node", "component"))
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200}


def test_near(docs, none):
    got = rows_of(near.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    by_id = {r[0]: r for r in got if r[0] is not None}
    assert len(got) == len(ROWS)
    assert by_id[1] == (1, 7, 1) and by_id[2] == (2, 7, 1) and by_id[3] == (3, 8, 1)
    assert by_id[4] == (4, 0, 4) and by_id[5] == (5, 0, 5) and by_id[6] == (6, 0, 6) and by_id[7] == (7, 1, 7)
    assert by_id[8][2] == by_id[9][2] == 8
    kept = near.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept.where("doc_id is not null"), "doc_id") == [(1,), (4,), (5,), (6,), (7,), (8,)]
    assert kept.where("doc_id is null").count() == 2
    assert near.near_duplicates(none).count() == 0 and near.keep_one_of_each(none).count() == 0


def test_near_threshold_is_exact(spark):
    # 7 words: 3 shingles; 4 of them with one more word: 3 of 4 shared is a link, 3 of 5 is none.
    base = [f"x{i}" for i in range(7)]
    texts = [" ".join(base), " ".join([*base, "y"]), " ".join([*base, "y", "z"]), " ".join([*base, "q", "r"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(near.near_duplicates(df), "doc_id", "component_id") == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_near_many_copies(spark):
    """A group larger than a part, texts that share a passage, and a chain between two groups."""
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(5000)]
    passage = [f"p{i}" for i in range(60)]
    one = [words[i] for i in rng.integers(0, 5000, 200)]
    texts = []
    for _ in range(150):
        copy = list(one)
        copy[int(rng.integers(0, 200))] = words[int(rng.integers(0, 5000))]
        texts.append(copy)
    texts += [[words[i] for i in rng.integers(0, 5000, 150)] + passage for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    from .test_queries import brute_components

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df).collect()}
    assert got == brute_components({i: " ".join(t) for i, t in enumerate(texts)})


def test_exact(docs, none):
    got = rows_of(exact.deduplicate(docs), "doc_id", "keep_id", "group_size", "kept")
    assert (1, 2, 3, False) in got and got.count((2, 2, 3, True)) == 1 and got.count((2, 2, 3, False)) == 1
    assert (4, 5, 3, False) in got and (5, 5, 3, True) in got and (None, 5, 3, False) in got
    assert (6, 6, 1, True) in got and (None, None, 1, True) in got and len(got) == len(ROWS)
    for old in (F.lit(True), F.lit(False), F.col("doc_id") < 3):
        assert rows_of(exact.deduplicate(docs, old), "doc_id", "keep_id", "group_size", "kept") == got
    kept = exact.keep_last_of_each(docs)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == sorted([(2,), (3,), (5,), (6,), (7,), (8,), (9,), (None,)], key=repr)
    assert exact.deduplicate(none).count() == 0 and exact.keep_last_of_each(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sources(docs, shard_words=5000)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    sizes = {r.source: r.source_size for r in rows}
    assert sizes == {"a": 33, "b": 30013, "c": 30010, None: 0}
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in sizes}
    target = {r.source: r.target for r in rows}
    assert target["a"] == 99 and target[None] == 0 and sum(target.values()) == pytest.approx(60056)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    mixed = mixing.mixed_documents(docs, shard_words=5000)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w"))
    assert dict(rows_of(words, "source", "w")) == {s: t for s, t in taken.items() if t}
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n c  ", 2), ("a b c", 3), ("a b c", 1), ("a", 1)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["a b", "a b c", "a", "a"]


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert sum(r.doc_id == 2 for r in got) == 2 and {r.length for r in got if r.doc_id in (4, 5)} == {1}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sorted(map(tuple, packing.pack_documents(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert packing.pack_documents(none).count() == 0


def test_packing_and_token_files_of_texts_with_blank_lines(spark):
    texts = ["a\n\nb", "a\n\n\n\nb", "end.\n\nThe next", "a\n\n", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoder = Encoder(default_path())
    ids = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, END_ID] for t in texts]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    want = [(n, len(x), c) for n, (x, c) in enumerate(zip(ids, crc, strict=True))]
    assert rows_of(packing.pack_documents(df), "doc_id", "length", "ids_crc32") == want
    want = [(n, sum(map(len, ids[:n])), len(x), c) for n, (x, c) in enumerate(zip(ids, crc, strict=True))]
    assert rows_of(tokenfiles.round_trip(df), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_open_bins_take_the_best_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]  # 4 and 3 places left
    assert bins.place(3) == (1, 7)  # fills bin 1, which closes
    assert bins.place(5) == (2, 0) and bins.place(9) == (3, 0)  # bin 0, the fuller of 0 and 2, closes
    assert bins.place(4) == (2, 5) and bins.place(1) in ((2, 9), (3, 9))


def test_search(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [-1.0]), (8, []), (50, [0.0, 1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", search.quantised(F.col("v")).alias("w"), F.lit(1).alias("rank"), F.lit(2).alias("block"))
    got = rows_of(search.exact_top_k(df, df.where("id % 50 = 0"), 3), "query_id", "rank", "id", "score")
    same = 256 * 256 + 128 * 128
    assert got[:3] == [(0, 1, 1, same), (0, 2, 2, same), (0, 3, 50, 128 * 256)]
    assert got[3:] == [(50, 1, 0, 128 * 256), (50, 2, 1, 128 * 256), (50, 3, 2, 128 * 256)]
    assert search.exact_top_k(df.where("false"), df.where("false"), 3).count() == 0
    assert search.exact_top_k(df.where("id = 0"), df.where("id = 0"), 3).count() == 0


def test_search_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-3, 4, int(rng.integers(0, 9))).tolist()) for i in range(300)]
    df = spark.createDataFrame(vectors, "id long, w array<long>")
    queries = df.where("id % 7 = 0")
    whole = rows_of(search.exact_top_k(df, queries, 4), "query_id", "rank", "id", "score")
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    monkeypatch.setattr(search, "QUERY_ROWS", 10)
    assert rows_of(search.exact_top_k(df, queries, 4), "query_id", "rank", "id", "score") == whole
    for q, own in vectors[::7]:
        scores = sorted((-sum(a * b for a, b in zip(own, w)), i) for i, w in vectors if i != q)[:4]
        assert [r[1:] for r in whole if r[0] == q] == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels))
    assert got.count() == len(ROWS) and got.where("score is null or held_out is null").count() == 0
    assert toxicity.score_documents(none, crf.Model()).count() == 0
    empty = toxicity.train(docs, labels.where("false"))
    assert toxicity.without_toxic(docs, empty).count() == len(ROWS)
    assert toxicity.without_toxic(docs, empty).columns == docs.columns


def test_crf_marginals_like_enumeration():
    rng = np.random.default_rng(1)
    for counts in ([1], [3, 1, 4], [7], [2, 2, 2]):
        n = sum(counts)
        e, m = np.exp(rng.normal(size=n)), np.exp(rng.normal(size=(2, 2)))
        first = np.zeros(n, bool)
        first[np.cumsum(counts) - counts] = True
        p = crf.marginals(e, first, m)[0]
        at = 0
        for c in counts:
            total, ones = 0.0, np.zeros(c)
            for code in range(1 << c):
                y = [code >> i & 1 for i in range(c)]
                weight = np.prod([e[at + i] ** y[i] for i in range(c)]) * np.prod([m[y[i], y[i + 1]] for i in range(c - 1)])
                total += weight
                ones += weight * np.array(y)
            assert np.allclose(p[at : at + c], ones / total)
            at += c


def test_spans_are_byte_offsets():
    c = crf.chain(pa.array(["é ab", None, "cd"]))
    assert list(zip(c.starts, c.ends, strict=True)) == [(0, 2), (3, 5), (0, 2)] and c.counts.tolist() == [2, 0, 1]


def test_language_model(docs, none):
    got = ngrams.score_documents(docs)
    assert got.count() == len(ROWS) and got.where("score is null or base_score is null").count() == 0
    assert {r.n_tokens for r in got.where("doc_id in (4, 5, 6)").collect()} == {1}
    assert ngrams.score_documents(none).count() == 0
    # All held out: nothing is known.
    blank = ngrams.score_documents(docs.where("doc_id = 7"), folds=1, held_out=0).first()
    assert (blank.held_out, blank.n_known, blank.train_tokens, blank.n_tokens) == (True, 0, 0, 2)


def test_filter_counts(spark):
    """Levels are never below the count's own, and rarely above."""
    words = [f"u{i}" for i in range(400)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(1 + i % 13))
    df = spark.createDataFrame([(text,)], "text string")
    counts = ngrams.counted(df, ngrams.SLICES)
    model = ngrams.build_filter(counts, *ngrams.level_totals(counts), 1, 1 << 16)
    tokens, sizes = ngrams.with_ends(pa.array([text]))
    grams, n = np.unique(tokens, return_counts=True)
    want = np.searchsorted(ngrams.LEVELS, n, side="right")
    level = model.levels(grams, 1)
    assert (level >= want).all() and (level > want).mean() < 0.05
    pairs, n = np.unique(ngrams.bigrams(tokens, sizes)[1], return_counts=True)
    assert (model.levels(pairs, 2) >= np.searchsorted(ngrams.LEVELS, n, side="right")).all()
    assert (ngrams.LEVELS[want - 1] <= np.unique(tokens, return_counts=True)[1]).all()


def test_scores_do_not_depend_on_the_size_of_the_broadcast_filter(docs):
    """What the broadcast has no room for is found in the rest of the filter; a bucket apart, false hits differ."""
    score = lambda size: {r[0]: (r[1], r[2]) for r in rows_of(ngrams.score_documents(docs, filter_bytes=size), "doc_id", "score", "n_tokens")}
    want = score(ngrams.FILTER_BYTES)
    for size in (1 << 9, 1 << 12, 1 << 14):
        got = score(size)
        assert got.keys() == want.keys()
        for i, (value, n) in want.items():
            assert got[i][0] / n == pytest.approx(value / n, abs=0.1), (size, i)


def test_resampling(docs, none):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert resampling.quality_sample(docs, labels).count() == len(ROWS)
    got = resampling.resample(docs, docs.where("doc_id = 8"), 5)
    assert got.count() == 5 and rows_of(got, "doc_id", "gumbel_key") == rows_of(resampling.resample(docs, docs.where("doc_id = 8"), 5), "doc_id", "gumbel_key")
    assert resampling.resample(docs, none, 100).count() == len(ROWS)
    assert resampling.resample(none, docs, 3).count() == 0
    every = resampling.resample(docs, docs.where("doc_id = 8"), 100).toPandas()
    assert sorted(every.gumbel_key)[-5:] == pytest.approx(sorted(got.toPandas().gumbel_key))


def test_token_files(docs, none, tmp_path):
    got = tokenfiles.round_trip(docs, f"file://{tmp_path}/t").collect()
    rows = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in got)
    assert [r[2] for r in rows] == [-1, -1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r[0] for r in rows] == [sum(x[1] for x in rows[:i]) for i in range(len(rows))]
    assert tokenfiles.round_trip(none).count() == 0
    file = next(tmp_path.glob("t/*.tok"))
    data = bytearray(file.read_bytes())
    data[40] ^= 1
    file.write_bytes(data)
    from pyarrow import fs

    with pytest.raises(ValueError, match="checksum"), fs.LocalFileSystem().open_input_file(str(file)) as f:
        list(tokenfiles.read_file(f))


def test_warc(spark, tmp_path):
    big = "<p>é\r\n\r\n</p>" * 20
    pages = [(1, "http://a/ b\nc", big), (2, "http://b", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"),
             (5, "u", None), (6, "u", ""), (None, "n", big), (7, "x", "y" * 99), (8, "x", "y" * 99), (9, "x", "z" * 100), (10, "x", "z" * 100)]
    df = spark.createDataFrame([(*p, 1, 2, "h") for p in pages], "page_id long, url string, html string, offset int, seq int, head string")
    got = rows_of(warc.round_trip(df, f"file://{tmp_path}/w"), "page_id", "payload_bytes", "record_type", "refers_to")
    n = len(big.encode())
    want = [(1, n, "response", None), (2, n, "revisit", 1), (2, n, "revisit", 1), (3, 5, "response", None), (4, 5, "response", None),
            (5, 0, "response", None), (6, 0, "response", None), (None, n, "revisit", 1), (7, 99, "response", None), (8, 99, "response", None),
            (9, 100, "response", None), (10, 100, "revisit", 9)]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_reads_selected_records_only(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 30) for i in range(200)], "page_id long, url string, html string")
    archives = warc.write_archives(df, f"file://{tmp_path}/w", archive_bytes=2_000)
    assert archives.index.select("path").distinct().count() > 4
    got = warc.read_records(archives.index.where("page_id % 10 = 3"), archives.path).collect()
    assert sorted(r.page_id for r in got) == list(range(3, 200, 10))
    assert all(r.payload.decode() == f"page {r.page_id} " * 30 and r.url == f"http://h/{r.page_id}" for r in got)
    assert list(warc._ranges([(0, 10), (10, 5), (15 + warc.GAP_BYTES + 1, 3)])) == [
        (0, 15, [(0, 10), (10, 5)]), (16 + warc.GAP_BYTES, 19 + warc.GAP_BYTES, [(16 + warc.GAP_BYTES, 3)])]


def test_word_labels_ignore_what_only_copies_share():
    rng = np.random.default_rng(2)
    plain = lambda: " ".join(f"n{i}" for i in rng.integers(0, 300, 40))
    copied = "these words stand in one text that was copied often"
    toxic = [f"{plain()} slur{i % 3} {plain()}" for i in range(60)] + [copied] * 60
    c = crf.chain(pa.array(toxic + [plain() for _ in range(120)]))
    labels = crf.word_labels([c], np.repeat([1.0, 0.0], 120))[0]
    words = " ".join(toxic).split()
    assert {w for w, y in zip(words, labels, strict=False) if y} == {"slur0", "slur1", "slur2"}
    assert labels.sum() == 60
