"""Exact dedup of new documents against immutable snapshots.

A snapshot stores each digest once, in exact buckets, and for each bucket a static binary-fuse filter.
Equal texts of a new batch are grouped on their own; the filter of its bucket then screens each
distinct digest. Only digests that may be in the snapshot join its exact bucket, and there the
texts themselves are compared byte by byte. Copies are counted before anything is shuffled, so a
text with very many copies is one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.workdir import settle
from . import fuse
from .names import unused

DIGESTS_PER_BUCKET = 250_000
MIN_BUCKETS = 16

_FILTERS = "bucket int, seed int, length int, segments int, fingerprints binary"


@dataclass
class Snapshot:
    """Digests of documents that no longer change."""

    entries: DataFrame  # bucket, key, text_sha256, n, last_id
    filters: DataFrame  # bucket, seed, length, segments, fingerprints
    buckets: int


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and SHA-256 of the UTF-8 text; NULL counts as the empty text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))


def _grouped(rows: DataFrame) -> DataFrame:
    """One row per digest; each task counts its own copies first."""
    return rows.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_id")
    ).withColumn("key", F.xxhash64("text_sha256"))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))


def _build(key, table):
    keys = np.array(table.column("key").to_pylist(), np.int64).view(np.uint64)
    seed, length, segments, data = fuse.build(keys)
    return pa.table(
        [
            pa.array([key[0].as_py()], pa.int32()), pa.array([seed], pa.int32()),
            pa.array([length], pa.int32()), pa.array([segments], pa.int32()), pa.array([data], pa.binary()),
        ],
        names=["bucket", "seed", "length", "segments", "fingerprints"],
    )


def take_snapshot(rows: DataFrame, expected: int = 0) -> Snapshot:
    """Store the digests of ``rows`` (doc_id, text_sha256) with a filter for every bucket.

    ``expected``: rows of the largest batch to come; buckets are as many as it or the snapshot needs.
    """
    entries = settle(_grouped(rows), "snapshot-digests")
    buckets = max(MIN_BUCKETS, -(-max(entries.count(), expected) // DIGESTS_PER_BUCKET))
    entries = _bucketed(entries, buckets)
    filters = entries.select("bucket", "key").groupBy("bucket").applyInArrow(_build, _FILTERS)
    return Snapshot(entries, settle(filters, "snapshot-filters"), buckets)


def _screen(key, batch, filters):
    if not filters.num_rows:
        return batch.slice(0, 0)
    row = filters.to_pylist()[0]
    keys = np.array(batch.column("key").to_pylist(), np.int64).view(np.uint64)
    found = fuse.contains((row["seed"], row["length"], row["segments"], row["fingerprints"]), keys)
    return batch.filter(pa.array(found))


def screened(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Distinct digests of a batch that may be in the snapshot; all that are in it, few others."""
    columns = ["text_sha256", "n", "last_id", "key", "bucket"]
    schema = "text_sha256 string, n long, last_id long, key long, bucket int"
    rows = _bucketed(batch, snapshot.buckets).select(*columns)
    return rows.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(_screen, schema)


def _same_bytes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``pairs`` whose documents new_id and old_id hold the same bytes.

    A document without id cannot be fetched; for it the digest decides.
    """
    ids = pairs.select(F.explode(F.array("new_id", "old_id")).alias("doc_id")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(
        ids.hint("shuffle_hash"), "doc_id", "left_semi"
    )
    # Repeated ids may stand for different texts: the digest picks the right one.
    texts = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.encode("text", "UTF-8").alias("bytes"))
    new = texts.select(F.col("doc_id").alias("new_id"), "text_sha256", F.col("bytes").alias("new_bytes")).dropDuplicates(["new_id", "text_sha256"])
    old = texts.select(F.col("doc_id").alias("old_id"), "text_sha256", F.col("bytes").alias("old_bytes")).dropDuplicates(["old_id", "text_sha256"])
    met = pairs.join(new, ["new_id", "text_sha256"], "left").join(old, ["old_id", "text_sha256"], "left")
    return met.where("new_bytes is null or old_bytes is null or new_bytes = old_bytes").drop("new_bytes", "old_bytes")


def dedup_batch(docs: DataFrame, batch: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """Groups of equal texts over a batch and snapshots: text_sha256, keep_id, group_size.

    ``docs`` holds the texts of both, ``batch`` the new digests (doc_id, text_sha256). Only groups of two
    rows or more are returned.
    """
    new = settle(_grouped(batch), "batch-digests")
    parts = new.select("text_sha256", "n", "last_id")
    for snapshot in snapshots:
        maybe = screened(new, snapshot)
        old = snapshot.entries.select("text_sha256", F.col("n").alias("old_n"), F.col("last_id").alias("old_id"))
        pairs = settle(
            maybe.select("text_sha256", F.col("last_id").alias("new_id")).join(old, "text_sha256"), "dedup-pairs"
        )
        same = settle(_same_bytes(pairs, docs).select("text_sha256", "old_n", "old_id"), "dedup-same")
        parts = parts.unionByName(same.select("text_sha256", F.col("old_n").alias("n"), F.col("old_id").alias("last_id")))
        # What a snapshot holds more than once stays a group whether or not the batch has it.
        rest = snapshot.entries.where("n > 1").join(same, "text_sha256", "left_anti")
        parts = parts.unionByName(rest.select("text_sha256", "n", "last_id"))
    groups = parts.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), F.max("last_id").alias("keep_id"))
    return groups.where("group_size > 1")


def deduplicate(docs: DataFrame, is_old=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows where ``is_old`` (a column; by default a fixed half by hash of the id) form the snapshot, the
    rest is the new batch; the split never changes the result. Of equal texts the largest doc_id
    stays. NULL and empty texts are equal; of rows that repeat an id and its text one is kept; a NULL id
    stays only when all its copies have none. Other columns are ignored.
    """
    if is_old is None:
        is_old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = settle(digests(docs).withColumn("old", F.coalesce(is_old, F.lit(False))), "digests")
    snapshot = take_snapshot(rows.where("old").drop("old"), rows.where("not old").count())
    groups = dedup_batch(docs, rows.where("not old").drop("old"), [snapshot])
    counted = rows.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    joined = counted.join(groups, "text_sha256", "left")
    size = F.coalesce("group_size", F.lit(1))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    each = joined.select(
        "doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "text_sha256",
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_last_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without exact copies, with all their columns: of equal texts the largest doc_id, once.

    NULL and empty texts are equal; a row without id stays only where all its copies have none, and one of
    repeated rows. Columns may have any name; an empty table gives an empty one.
    """
    found = settle(deduplicate(docs), "dedup")
    own, kept_id, kept_sha = unused(docs.columns, "own", "id", "sha")
    kept = found.where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn(own, F.sha2(text, 256))
    rows = marked.join(
        kept.hint("shuffle_hash"),
        F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_sha)),
        "left_semi",
    )
    repeated = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(["doc_id", own])
    return rows.drop(own)
