"""Files of token ids: range-coded, checksummed blocks and a table of documents.

Documents are range-partitioned by id and tokenised where they land, so ids are never shuffled. Each
task writes one file, coding many blocks side by side, and reports it; only files of tasks
whose report was kept belong to the output, so a task that runs again does no harm. A file is

    "WLTOK002", groups, documents, footer

    group:      number of blocks, length and crc32 of the table of ids (each 4 bytes), table, blocks
    block:      number of ids, length and crc32 of the payload (each 4 bytes), payload
    documents:  a flag byte (1: the id is NULL), id (8 bytes) and number of ids (8 bytes) of each, in order
    footer:     place of the documents (8 bytes), their number (8), crc32 of them (4), number of groups (4)

with little-endian integers. Blocks are coded independently, see ``codec``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.workdir import new_path, settle
from . import codec
from .tokens import END_ID, SLICE_BYTES, Encoder, default_path
from .words import slices

MAGIC = b"WLTOK002"
LANES = 1024
TEXTS_PER_FILE = 8_000
_HEAD, _FOOT = "<III", "<QQII"
_DOCUMENT = np.dtype([("null", "u1"), ("id", "<i8"), ("n", "<u8")])


def _store(path: str):
    from pyarrow import fs

    # Spark names local folders file:/a or /a, Arrow file:///a.
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class Writer:
    """Writes one file, block by block."""

    def __init__(self, out, lanes: int = LANES):
        self.out, self.lanes = out, lanes
        self.waiting: list[np.ndarray] = []
        self.held = self.groups = 0
        self.at = out.write(MAGIC)
        self.documents: list[np.ndarray] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        rows = np.zeros(len(doc_ids), _DOCUMENT)
        rows["null"] = [d is None for d in doc_ids]
        rows["id"] = [d or 0 for d in doc_ids]
        rows["n"] = counts
        self.documents.append(rows)
        self.waiting.append(ids.astype(np.uint32))
        self.held += len(ids)
        full = self.lanes * codec.BLOCK_IDS
        while self.held >= full:
            every = np.concatenate(self.waiting)
            self._code(every[:full])
            self.waiting, self.held = [every[full:]], self.held - full

    def _put(self, n: int, payload: bytes) -> None:
        self.at += self.out.write(struct.pack(_HEAD, n, len(payload), zlib.crc32(payload)) + payload)

    def _code(self, ids: np.ndarray) -> None:
        """One group: the table of its ids and their blocks."""
        table, payloads = codec.encode(ids)
        if payloads:
            self._put(len(payloads), table)
            self.groups += 1
        for i, payload in enumerate(payloads):
            self._put(min(codec.BLOCK_IDS, len(ids) - i * codec.BLOCK_IDS), payload)

    def close(self) -> tuple[int, int]:
        """Number of documents and ids."""
        self._code(np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32))
        documents = np.concatenate(self.documents) if self.documents else np.zeros(0, _DOCUMENT)
        data = documents.tobytes()
        self.out.write(data + struct.pack(_FOOT, self.at, len(documents), zlib.crc32(data), self.groups))
        return len(documents), int(documents["n"].sum())


def read_file(file) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents (null, id, n) and their ids, some documents at a time; checksums are verified."""
    end = file.size() - struct.calcsize(_FOOT)
    place, _, crc, groups = struct.unpack(_FOOT, file.read_at(struct.calcsize(_FOOT), end))
    data = file.read_at(end - place, place)
    if file.read_at(len(MAGIC), 0) != MAGIC or zlib.crc32(data) != crc:
        raise ValueError("not a whole token file")
    documents = np.frombuffer(data, _DOCUMENT)
    ends = np.cumsum(documents["n"].astype(np.int64))
    at, done, have, taken = len(MAGIC), 0, np.zeros(0, np.uint32), 0

    def part() -> tuple[int, bytes]:
        nonlocal at
        count, length, crc = struct.unpack(_HEAD, file.read_at(struct.calcsize(_HEAD), at))
        payload = file.read_at(length, at + struct.calcsize(_HEAD))
        if zlib.crc32(payload) != crc:
            raise ValueError(f"block at {at}: checksum differs")
        at += struct.calcsize(_HEAD) + length
        return count, payload

    for _ in range(groups):
        blocks, table = part()
        counts, payloads = zip(*[part() for _ in range(blocks)], strict=True)
        have = np.concatenate([have, *codec.decode(table, list(payloads), list(counts))])
        whole = int(np.searchsorted(ends, taken + len(have), side="right"))
        if whole > done:
            used = int(ends[whole - 1]) - taken
            yield documents[done:whole], have[:used]
            have, taken, done = have[used:], taken + used, whole
    if done < len(documents):
        raise ValueError("ids are missing at the end of the file")


def _write(path: str, tokenizer: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = TaskContext.get()
        number = task.partitionId()
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/part-{number:06d}-{task.taskAttemptId()}.tok"
        encoder = Encoder(tokenizer)
        with store.open_output_stream(name) as out:
            writer = Writer(out)
            batch = first
            while batch is not None:
                for part in slices(batch, "text", SLICE_BYTES):
                    ids, counts = encoder.encode(part.column("text"))
                    ends = np.cumsum(counts + 1)
                    every = np.full(int(ends[-1]), END_ID, np.uint32)
                    inner = np.ones(len(every), bool)
                    inner[ends - 1] = False
                    every[inner] = ids
                    writer.add(part.column("doc_id").to_pylist(), every, counts + 1)
                batch = next(batches, None)
            n, total = writer.close()
        size = store.get_file_info(name).size
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([size], pa.int64())],
            names=["file", "name", "n_docs", "n_ids", "bytes"],
        )

    return rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, texts_per_file: int = TEXTS_PER_FILE) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``path`` in ascending doc_id order, NULL first.

    Returns the list of files: file, name, n_docs, n_ids, bytes, and first (ids in the files before).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = max(1, -(-rows.count() // texts_per_file))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "file int, name string, n_docs long, n_ids long, bytes long"
    listed = settle(ordered.mapInArrow(_write(path, tokenizer or default_path()), schema), "token-files")
    # One row per file, not per document.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return listed.withColumn("first", F.sum("n_ids").over(before) - F.col("n_ids"))


def _read(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["first"]
                with store.open_input_file(row["name"]) as file:
                    for documents, ids in read_file(file):
                        n = documents["n"].astype(np.int64)
                        ends = np.cumsum(n)
                        own = ids.astype("<u4")
                        crc = [zlib.crc32(own[b - k : b].tobytes()) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(documents["id"], mask=documents["null"] == 1), pa.array(start + ends - n),
                                pa.array(n), pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        start += int(ends[-1])

    return rows


def read_documents(files: DataFrame, path: str) -> DataFrame:
    """Per document of the listed files: doc_id, start, n_tokens, ids_crc32, from the decoded ids."""
    n = max(1, files.count())
    dealt = files.select("file", "name", "first").repartitionByRange(n, "file")
    return dealt.mapInArrow(_read(path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write token files and read them back: doc_id, start, n_tokens, ids_crc32 of every row.

    A document is its ids and the end id 0; a NULL or empty text is the end id alone. Repeated rows are
    written each, a NULL id comes first, other columns are ignored, an empty table writes no file.
    """
    path = path or new_path(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, path, tokenizer), path)
