"""Toxicity of documents: tagged words, their offsets and a score per document.

A two-label conditional random field is fitted on a bounded sample of labelled documents: at most
SAMPLE of each label, chosen by a hash of their id. Word labels come from the documents' labels (see
``crf.word_labels``). Scores use the text alone. All texts are scored on the executors, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import crf
from .words import released, slices

SAMPLE = 1500
FOLDS = 5


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id gives NULL."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``sample`` documents of each label outside of the held-out fold.

    Rows of ``labels`` without id or label are left out; of a repeated id the larger label counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic in (0, 1)").where(fold(F.col("id")) != 0)
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("id", F.lit(11)), F.col("id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(sample)
    )
    ids = docs.withColumn("id", F.col("doc_id").cast("long")).select("id", F.col("text").cast("string").alias("text"))
    # At most 2 * sample rows: a bound by construction. Repeated ids bring their texts in order.
    rows = ids.join(F.broadcast(chosen), "id").where("text is not null")
    return rows.orderBy(F.xxhash64("id", F.lit(12)), "id", F.sha2("text", 256)).limit(2 * sample).select("text", "toxic")


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the whole sample, as one row; no row without labels of both kinds."""
    chains, toxic = [], []
    for batch in batches:
        for part in slices(batch, "text"):
            chains.append(crf.chain(part.column("text")))
            toxic += part.column("toxic").to_pylist()
    if len(set(toxic)) == 2:
        model = crf.fit(chains, np.array(toxic, np.float64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([model.weights.tobytes()], pa.binary()), pa.array([float(model.bias)]),
                pa.array([model.step.ravel().tolist()], pa.list_(pa.float64())),
                pa.array([model.document.tolist()], pa.list_(pa.float64())),
            ],
            names=["weights", "bias", "step", "document"],
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> crf.Model:
    """Fit in one task, whose size the sample bounds; only the model (4 MB) reaches the driver.

    Without labels of both kinds the model scores every text alike, below 0.5.
    """
    rows = training_sample(docs, labels, sample).coalesce(1)
    schema = "weights binary, bias double, step array<double>, document array<double>"
    found = rows.mapInArrow(released(_fit), schema).collect()
    if not found:
        model = crf.Model()
        model.document[0] = -3.0
        return model
    row = found[0]
    return crf.Model(
        np.frombuffer(row["weights"], np.float32), row["bias"],
        np.array(row["step"]).reshape(2, 2), np.array(row["document"]),
    )


def _score(broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                c = crf.chain(part.column("text"))
                p = crf.tag(model, c)
                scores = crf.document_scores(model, p, c.counts)
                at = np.flatnonzero(p >= 0.5)
                text = np.repeat(np.arange(len(c.counts)), c.counts)[at]
                offsets = np.searchsorted(text, np.arange(len(c.counts) + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(c.starts[at]), pa.array(c.ends[at]), pa.array(p[at])], ["start", "end", "probability"]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores), pa.ListArray.from_arrays(pa.array(offsets), spans)],
                    names=["doc_id", "score", "spans"],
                )

    return rows


def score_documents(docs: DataFrame, model: crf.Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, spans.

    ``spans``: the tagged words as byte offsets in the UTF-8 text, with their marginals. A NULL, empty or
    blank text has no spans and the score of a text without tags. A NULL id is held out of nothing;
    repeated rows are scored each; other columns are ignored.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the corpus
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, score double, spans array<struct<start: long, end: long, probability: double>>"
    return rows.mapInArrow(released(_score(broadcast)), schema).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def _keep(broadcast, text: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            for part in slices(batch, text):
                c = crf.chain(part.column(text))
                clean = crf.document_scores(model, crf.tag(model, c), c.counts) < 0.5
                yield part.filter(pa.array(clean))

    return rows


def without_toxic(docs: DataFrame, model: crf.Model) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with all their columns.

    A NULL, empty or blank text has the score of a text without tags; repeated rows and rows without id are
    judged each. Columns may have any name; an empty table gives an empty one.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    # Numbered while Python sees them: a name with a dot would be read as a field.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    return numbered.mapInArrow(released(_keep(broadcast, text)), numbered.schema).toDF(*docs.columns)
