"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once, on the executors; only the list of pieces (their lengths and
places) is shuffled. Pieces are dealt by hash over shards of a bounded number of tokens, and each
shard packs its own by bounded-space online best fit: a fixed number of bins is open, held by
free space, with a bit set for each free space that occurs. A piece goes to the bin it fills best;
if none has room a new bin opens, and if too many are open the fullest closes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.workdir import TEXT_BATCHES, settle
from .tokens import END_ID, SLICE_BYTES, Encoder, default_path
from .words import released, slices

SEQUENCE = 2048
OPEN_BINS = 1024
SHARD_SEQUENCES = 16_384
SHARD_PIECES = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class OpenBins:
    """The open bins of one shard."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.by_space: list[list[int]] = [[] for _ in range(size + 1)]
        self.spaces = 0  # bit s is set when an open bin has s places free
        self.open = self.bins = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.spaces &= ~(1 << space)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        fits = self.spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
                self.open -= 1
            space, at = self.size, self.bins
            self.bins += 1
            self.open += 1
        left = space - length
        if left:
            self.by_space[left].append(at)
            self.spaces |= 1 << left
        else:
            self.open -= 1
        return at, self.size - space


def _cut(path: str, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, counts = encoder.encode(part.column("text"))
                ends = np.cumsum(counts)
                out: list[list] = [[] for _ in range(5)]
                for doc, a, b in zip(part.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    start, piece = 0, 0
                    end = len(own) % size or size
                    while start < len(own):
                        for column, value in zip(out, (doc, piece, start, end - start, zlib.crc32(own[start:end].tobytes())), strict=True):
                            column.append(value)
                        start, end, piece = end, end + size, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows


def document_pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``size`` ids; only the first piece of a longer document may be shorter."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(released(_cut(path or default_path(), size)), PIECES)


def _pack(size: int, most: int):
    def rows(key, table):
        order = ["place", "doc_id", "piece", "ids_crc32"]
        table = table.sort_by([(c, "ascending") for c in order])
        bins = OpenBins(size, most)
        placed = [bins.place(n) for n in table.column("length").to_pylist()]
        shard = key[0].as_py()
        sequence = pa.array([(shard << 32) + at for at, _ in placed], pa.int64())
        offset = pa.array([o for _, o in placed], pa.int64())
        columns = [table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table(
            [*columns, sequence, offset],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    return rows


def pack_documents(
    docs: DataFrame, path: str | None = None, size: int = SEQUENCE, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``size`` ids.

    A document is its ids and then the end id 0; a NULL or empty text is the end id alone. One row per
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed
    as often as they come, a NULL doc_id is packed like any other, other columns are ignored, and
    an empty table gives an empty table. The same rows always get the same places.
    """
    pieces = settle(document_pieces(docs, path, size), "pieces", TEXT_BATCHES)
    total = pieces.agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("c")).first()
    shards = max(1, -(-(total["n"] or 0) // (size * SHARD_SEQUENCES)), -(-total["c"] // SHARD_PIECES))
    place = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("place", place).withColumn("shard", F.pmod("place", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(size, open_bins), PACKED)
