"""The registered queries: SQL where there is one, brute force elsewhere."""

import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from wordloom.llm.queries import ORACLES, QUERIES
from wordloom.llm.tokens import default_path

from .test_words_tokens import WORD, lower, plain_shingles


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    outcome = compare(spark, connect(sf_dir), name, sf_dir)
    assert outcome.startswith("OK"), outcome


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 11))


def brute_components(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_op2(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert got == brute_components(dict(zip(docs.doc_id, docs.text, strict=True)))


def test_op3(spark, sf_dir, docs):
    got = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").toxic
    assert got.doc_id.is_unique and len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    held = got[got.held_out & got.doc_id.isin(labels.index)]
    assert (held.predicted.to_numpy() == labels[held.doc_id].to_numpy()).mean() >= 0.95


def test_op4(spark, sf_dir, docs):
    got = QUERIES["op4_lm_scoring"](spark, sf_dir).toPandas().set_index("doc_id")
    tokens = {i: [*WORD.findall(lower(t or "")), None] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = {}
    for i, own in tokens.items():
        for w in [] if held[i] else own:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        row = got.loc[i]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + 1 * (v + 1))) for w in own)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[i], len(own), n)
        assert row.n_known == sum(w in counts for w in own)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert row.score < 0
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def expected_ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in zip(docs.doc_id, docs.text, strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op5(spark, sf_dir, docs):
    got = QUERIES["op5_best_fit_packing"](spark, sf_dir).toPandas().sort_values(["doc_id", "piece"])
    want = expected_ids(docs)
    for doc, rows in got.groupby("doc_id"):
        ids = want.pop(doc)
        assert rows.piece.tolist() == list(range(len(rows))) and rows.length.sum() == len(ids)
        assert (rows.length.to_numpy()[1:] == 2048).all() or len(rows) == 1
        for r in rows.itertuples():
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.length <= 2048
    assert not want
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.1 * np.ceil(got.length.sum() / 2048) + 1


def test_op6(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op6_quality_resampling"](spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert got.doc_id.is_unique and len(got) == round(labels.quality.mean() * 1000)
    kept = labels.doc_id.isin(got.doc_id)
    assert kept[labels.quality == 1].mean() > 0.9 and kept[labels.quality == 0].mean() < 0.5


def test_op8(spark, sf_dir, docs):
    got = QUERIES["op8_token_files"](spark, sf_dir).toPandas().sort_values("doc_id")
    want, start = expected_ids(docs), 0
    assert got.doc_id.tolist() == sorted(want)
    for r in got.itertuples():
        ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def waterfill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def test_op9(spark, sf_dir, docs):
    got = QUERIES["op9_source_mixing"](spark, sf_dir).toPandas()
    size = {i: len(WORD.findall(t or "")) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    target = waterfill(sizes)
    assert sorted(got.doc_id) == sorted(size)
    for r in got.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-12) and 0 <= r.taken <= 3 * r.size
    taken = got.groupby("source").taken.sum()
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = QUERIES["op9_source_mixing"](spark, sf_dir).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
