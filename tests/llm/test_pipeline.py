"""Each stage of the pipeline against a brute-force version on what the stage before it kept."""

import numpy as np
import pytest

import corpus_pipeline
from wordloom.functions.workdir import settle

from .test_queries import WORD, brute_components, crc, expected_ids, waterfill


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returned, after the documents themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = settle(stage(spark, docs, sf_dir), name)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
        out.append(docs.toPandas())
    return out


def pairs(df):
    return sorted(zip(df.doc_id, df.text, strict=True))


def test_toxicity(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").toxic
    kept = stages[0].doc_id.isin(stages[1].doc_id)
    known = stages[0].doc_id.isin(labels.index)
    wrong = kept[known].to_numpy() == (labels[stages[0].doc_id[known]].to_numpy() == 1)
    assert 0 < (~kept).sum() and wrong.mean() < 0.1
    assert pairs(stages[0][kept]) == pairs(stages[1])


def test_exact_dedup(stages):
    last = {}
    for doc, text in pairs(stages[1]):
        last[text or ""] = max(doc, last.get(text or "", doc))
    assert sorted(last.values()) == sorted(stages[2].doc_id)


def test_near_duplicates(stages):
    found = brute_components(dict(zip(stages[2].doc_id, stages[2].text, strict=True)))
    assert sorted(stages[3].doc_id) == sorted(i for i, (_, root) in found.items() if i == root)
    assert len(stages[3]) < len(stages[2])


def test_mixing(stages):
    before, after = stages[3], stages[4]
    words = lambda df: df.text.fillna("").map(lambda t: len(WORD.findall(t)))
    sizes = words(before).groupby(before.source).sum().to_dict()
    target, taken = waterfill(sizes), words(after).groupby(after.source).sum()
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in target.items())
    texts = dict(zip(before.doc_id, before.text, strict=True))
    times = after.doc_id.value_counts()
    assert times.max() <= 3
    for doc, text in zip(after.doc_id, after.text, strict=True):
        assert text == texts[doc] or texts[doc].lstrip().startswith(text)


def test_packing(spark, sf_dir, stages):
    packed = stages[5]
    docs = stages[4].reset_index(drop=True)
    want = sorted((len(ids), crc(ids[: len(ids) % 2048 or 2048])) for ids in (
        expected_ids(docs.iloc[[i]])[docs.doc_id[i]] for i in range(len(docs))
    ))
    first = packed[packed.piece == 0]
    assert sorted(first.ids_crc32) == sorted(c for _, c in want)
    assert packed.length.sum() == sum(n for n, _ in want) and packed.length.max() <= 2048
    for _, rows in packed.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 2048


def test_run_is_the_stages_one_after_the_other(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, stages[5][columns].values.tolist()))
