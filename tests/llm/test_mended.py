"""Rows without ids, helper names as a user's columns, draws and scores held against plain versions."""

import math
import struct
import zlib
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import exact, mixing, near, ngrams, resampling, toxicity
from wordloom.llm.crf import Model
from wordloom.llm.names import unused

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def test_names_that_are_free():
    assert unused(["__A", "__a_", "b"], "a", "b", "b") == ["__a__", "__b", "__b_"]


def test_near_copies_without_ids(spark):
    other = " ".join(f"x{i}" for i in range(30))
    rows = [
        (None, BASE, "a"), (None, BASE + " more", "a"), (None, BASE + " and more", "b"),  # linked, none has an id
        (7, other, "a"), (None, other + " end", "a"), (9, "start " + other + " end", "a"),  # one of three has none
        (None, "short", "a"), (None, "", "a"), (None, None, "a"), (11, "short text", "b"), (None, "short", "a"),
    ]
    df = table(spark, rows)
    got = near.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert Counter(r["component_id"] for r in got if r["n_shingles"] > 10) == {None: 3, 7: 3}
    kept = Counter((r["doc_id"], r["text"]) for r in near.keep_one_of_each(df).collect())
    linked = [(i, t) for (i, t), n in kept.items() for _ in range(n) if i is None and t and t.startswith(BASE)]
    assert len(linked) == 1 and kept[7, other] == 1 and kept[9, "start " + other + " end"] == 0
    assert kept[None, "short"] == 1 and kept[None, ""] == 1 and kept[None, None] == 1 and kept[11, "short text"] == 1
    assert sum(kept.values()) == 6


NAMES = [
    "__own", "__id", "__sha", "__of", "__size", "__taken", "__each", "__words", "__nth", "__n", "__kept", "__row", "__one",
    "__copy", "__source", "__node", "__level", "__shard", "row", "component", "component_id", "sid", "n", "key", "size", "taken",
    "copy", "shard", "place", "kept", "text_sha256", "group_size", "keep_id", "old", "gid", "score", "id", "toxic", "a.b", "Text_",
]


@pytest.mark.parametrize("stage", ["toxic", "exact", "near", "mix"])
def test_helper_names_as_user_columns(spark, stage):
    rows = [(1, BASE, "a"), (2, BASE, "a"), (3, BASE + " more", "b"), (4, "something else", "b"), (None, "no id", None), (6, None, "a")]
    df = table(spark, rows)
    for name in NAMES:
        df = df.withColumn(name, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":" + name)))
    run = {
        "toxic": lambda d: toxicity.without_toxic(d, _clean_model()),
        "exact": exact.keep_last_of_each, "near": near.keep_one_of_each, "mix": mixing.mixed_documents,
    }[stage]
    out = run(df)
    assert out.columns == df.columns
    found = out.collect()
    assert found
    for r in found:
        for name in NAMES:
            assert r[name] == f"{'-' if r['doc_id'] is None else r['doc_id']}:{name}"


def _clean_model():
    model = Model()
    model.document[0] = -3.0
    return model


@pytest.mark.parametrize("quota, left, n", [(10, 10, 40), (20, 5, 200), (500, 800, 2000), (40, 40, 40), (0, 5, 9), (7, 0, 9)])
def test_splits_are_hypergeometric(spark, quota, left, n):
    draws = 8000
    columns = [F.lit(x).cast("long") for x in (quota, left, n - left)]
    counts = spark.range(draws).select(mixing._left_quota(*columns, F.lit(7), F.col("id")).alias("k")).groupBy("k").count()
    seen = {r["k"]: r["count"] / draws for r in counts.collect()}
    law = {k: comb(left, k) * comb(n - left, quota - k) / comb(n, quota) for k in range(max(0, quota - n + left), min(quota, left) + 1)}
    assert set(seen) <= set(law)
    far = sum(abs(seen.get(k, 0) - p) for k, p in law.items()) / 2
    assert far < 1.5 * sum(math.sqrt(p * (1 - p) / draws) for p in law.values()) / 2 + 0.01


def test_tree_keeps_quotas(spark):
    """Quotas of shards add up to those of sources and never exceed what a shard holds."""
    rng = np.random.default_rng(1)
    rows = [(s, s * 1000 + 77, k, int(rng.integers(0, 3000))) for s in range(4) for k in range(13)]
    leaves = spark.createDataFrame([(f"s{s}", q, k, w) for s, q, k, w in rows], "source string, quota long, shard long, words long")
    got = {(r["source"], r["shard"]): r["quota"] for r in mixing.shard_quotas(leaves, 4, 7).collect()}
    words = {(f"s{s}", k): w for s, _, k, w in rows}
    for s in range(4):
        assert sum(q for (source, _), q in got.items() if source == f"s{s}") == s * 1000 + 77
    assert all(q <= words.get(k, 0) for k, q in got.items())


def test_resampling_by_hand(spark):
    """Log ratios of hashed counts, Gumbel noise from the id's hash, the k largest sums."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"], rng.integers(0, 9))), "s") for i in range(60)]
    docs, target = table(spark, rows), table(spark, rows).where("doc_id < 12")
    buckets = 50

    def features(text):
        return resampling._features(pa.array([text]), buckets)[0].tolist()

    def log_frequency(some):
        n = Counter(b for _, text, _ in some for b in features(text))
        return [math.log((1 + n[b]) / (buckets + sum(n.values()))) for b in range(buckets)]

    good, every = log_frequency(rows[:12]), log_frequency(rows)
    keys = {}
    for i, text, _ in rows:
        weight = sum(good[b] - every[b] for b in features(text))
        first = xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<i", 3), seed=first).intdigest()
        uniform = ((h - (1 << 64) if h >> 63 else h) % (1 << 52) + 0.5) / (1 << 52)
        keys[i] = weight - math.log(-math.log(uniform))
    got = {r["doc_id"]: r["gumbel_key"] for r in resampling.resample(docs, target, 20, buckets).collect()}
    assert set(got) == set(sorted(keys, key=keys.get)[-20:])
    assert all(got[i] == pytest.approx(keys[i]) for i in got)


def test_resampling_ties(spark):
    """Equal keys: as many as are wanted, those with the smallest ids."""
    rows = spark.createDataFrame([(i, 5) for i in range(40)] + [(100 + i, 9) for i in range(3)], "doc_id long, key long")
    got = sorted(r["doc_id"] for r in resampling._largest(rows, 8).collect())
    assert got == [0, 1, 2, 3, 4, 100, 101, 102]


def test_scores_from_exact_counts(spark):
    """The model's score by its formula from exact counts, each rounded down or up to a level."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(30)], rng.integers(0, 40))), "s") for i in range(80)]
    levels = [int(x) for x in ngrams.LEVELS]

    def low(c):
        return max((x for x in levels if x <= c), default=0)

    def high(c):
        return next(x for x in levels if x > c) - 1 if c else 0

    learnt = [text.split() + ["<end>"] for i, text, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for t in learnt for w in t)
    two = Counter(p for t in learnt for p in zip([None, *t[:-1]], t, strict=True))
    total, distinct = sum(one.values()), len(one)
    got = {r["doc_id"]: r for r in ngrams.score_documents(table(spark, rows)).collect()}
    exact_ones = 0
    for i, text, _ in rows:
        score = 0.0
        tokens = text.split() + ["<end>"]
        for before, w in zip([None, *tokens[:-1]], tokens, strict=True):
            most = len(learnt) if before is None else high(one[before])
            seen = min(low(two[before, w]), high(one[w]), most)
            level = sum(x <= (len(learnt) if before is None else one[before]) for x in levels)
            share = min(max(0.3 + 0.4 * (level - 1) / 27, 0.3), 0.7) if most else 0.0
            plain = (low(one[w]) + 1) / (total + distinct + 1)
            score += math.log10(share * (seen / most if most else 0.0) + (1 - share) * plain)
        exact_ones += abs(got[i]["score"] - score) < 1e-9
        assert got[i]["n_known"] == sum(one[w] > 0 for w in tokens) and got[i]["train_tokens"] == total
    assert exact_ones >= 78  # a probe errs now and then


def test_pipeline_on_odd_rows(spark, sf_dir, tmp_path):
    """NULL ids and texts, empty and long texts, repeated rows, extra columns; and no rows at all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, None, "a"), (None, "", None), (None, BASE, "a"), (None, BASE, "a"), (5001, BASE + " more", None), (5001, BASE + " more", None)]
    odd += [(5002, " ".join(f"w{i % 313}" for i in range(20_000)), "b"), (5003, " \n", "b")]
    rows = docs.unionByName(table(spark, odd)).withColumn("__id", F.lit("mine"))
    for name, some in (("odd", rows), ("none", rows.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert per <= 2048 and packed.where("doc_id = 5002").count() > 0
    assert packed.where("doc_id is null or doc_id = 5001").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
