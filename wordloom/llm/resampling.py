"""Importance resampling: documents like a target, drawn from all by hashed n-gram models.

Two generative models, of the target and of all documents, hold the frequencies of hashed
unigrams and bigrams. A document's weight is the ratio of its likelihoods; the sample takes the k
largest sums of log weight and Gumbel noise, which draws k documents without replacement in
proportion to their weights. The k-th largest key is found by counting its bits, 16 at a time, over all
documents: nothing is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.workdir import settle
from .words import hashed_words, mix, seeds, slices

BUCKETS = 10_000
TARGET_ROWS = 4000


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text of each."""
    words, counts, _ = hashed_words(texts)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    salt = seeds(2, 99)
    two = mix(words[inside] * salt[0] + words[inside + 1] * salt[1]) if len(inside) else np.zeros(0, np.uint64)
    grams = np.concatenate((words, two)) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate((text, text[inside]))


def _counts(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_features(part.column("text"), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return rows


def log_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log frequency of each bucket over all texts of ``docs``, with one added to each."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(buckets), "bucket long, n long")
    # One row per bucket, whatever the corpus.
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.ones(buckets)
    n[rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return np.log(n / n.sum())


def _weigh(broadcast, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = broadcast.value
        for batch in batches:
            for part in slices(batch, "text"):
                grams, text = _features(part.column("text"), buckets)
                weight = np.bincount(text, weights=ratio[grams], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight)], names=["doc_id", "log_weight"])

    return rows


def _largest(rows: DataFrame, k: int) -> DataFrame:
    """The k rows with the largest ``key`` (long, not negative), ties to smaller ids."""
    if rows.count() <= k:
        return rows
    low, left = 0, k  # low: bits of the k-th key found so far; left: rows still wanted among equals
    for shift in (48, 32, 16, 0):
        within = rows if shift == 48 else rows.where(F.shiftright("key", shift + 16) == low)
        steps = within.groupBy(F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")).count().collect()
        for row in sorted(steps, key=lambda r: -r["digit"]):
            if row["count"] >= left:
                low = low << 16 | row["digit"]
                break
            left -= row["count"]
    above = rows.where(F.col("key") > low)
    # Equal 64-bit keys: as good as none, unless rows repeat.
    ties = rows.where(F.col("key") == low).orderBy(F.col("doc_id").asc_nulls_last()).limit(left)
    return above.unionByName(ties)


def resample(docs: DataFrame, target: DataFrame, k: int, buckets: int = BUCKETS, seed: int = 3) -> DataFrame:
    """``k`` rows of ``docs`` (doc_id, text) drawn by importance: doc_id, log_weight, key.

    ``target``: texts to resemble. NULL and empty texts have weight 1 (log 0); fewer than k rows all
    stay; repeated rows share their noise and are drawn like others; a NULL id has noise of its own;
    an empty target weighs every bucket alike. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio = log_frequencies(target, buckets) - log_frequencies(rows, buckets)
    broadcast = docs.sparkSession.sparkContext.broadcast(ratio)
    weighed = rows.mapInArrow(_weigh(broadcast, buckets), "doc_id long, log_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    # A long in the order of the doubles, in steps of 2 ** -24; sums beyond 2 ** 37 tie.
    place = F.greatest(F.least(F.col("gumbel_key"), F.lit(2.0**37)), F.lit(-(2.0**37)))
    keyed = keyed.withColumn("key", (F.round((place + F.lit(2.0**37)) * F.lit(2.0**24))).cast("long"))
    return _largest(settle(keyed, "resample"), k).select("doc_id", "log_weight", "gumbel_key")


def quality_sample(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Documents drawn to resemble those labelled of good quality, as many as are good by the labels.

    The target is a bounded sample: at most ``target_rows`` labelled documents, by a hash of their id.
    k is the share of good ones among the labels, of all documents; without labels all stay. Labels without
    id or of another value are left out. NULL and empty texts have weight 1; repeated rows and rows without id
    are drawn like others; other columns are ignored; an empty table gives an empty one.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")
    )
    good = known.where("quality = 1").select("id").distinct().orderBy(F.xxhash64("id", F.lit(21)), "id").limit(target_rows)
    share = known.agg(F.avg("quality")).first()[0]
    target = docs.withColumn("id", F.col("doc_id").cast("long")).join(F.broadcast(good), "id", "left_semi")
    n = docs.count()
    return resample(docs, target, n if share is None else round(share * n))
