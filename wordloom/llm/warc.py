"""WARC archives: written by tasks, indexed by byte range, read back by coalesced ranges.

Pages meet what is known of their payload's digest in one shuffle, and each task writes its records to
archives of bounded size, one gzip member per record, and returns an index row for each: archive, offset,
length, URL and digest. Only archives of index rows that were kept belong to the output, so a
task that runs again does no harm. Readers take index rows, sort them by offset, merge neighbours into
ranges of bounded size and parse the records. A payload that an earlier page has as well is
written once; other pages revisit it by digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.workdir import new_path, settle

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
REVISIT_BYTES = 100
_END = "\r\n\r\n"

RECORD = "page_id long, record_type string, refers_to long, payload binary, payload_digest string, url string"
INDEX = "path string, offset long, length long, url string, payload_digest string, page_id long, record_type string, refers_to long"


@dataclass
class Archives:
    path: str  # the folder
    index: DataFrame  # see INDEX


def _store(path: str):
    from pyarrow import fs

    # Spark writes file:/a/b, Arrow reads file:///a/b.
    path = re.sub("^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def record_bytes(page_id, url, html: bytes, digest: str, refers_to, kind: str) -> bytes:
    """A whole record, not compressed. A revisit has no block."""
    block = b""
    if kind == "response":
        block = (
            f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}{_END}"
        ).encode() + html
    name = hashlib.md5(f"{page_id}|{url}|{digest}|{kind}".encode()).hexdigest()
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        "WARC-Page-ID": page_id,
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join(["WARC/1.1", *lines]) + _END).encode() + block + _END.encode()


def _write(path: str, archive_bytes: int):
    names = ["path", "offset", "length", "url", "payload_digest", "page_id", "record_type", "refers_to"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = _store(path)
        out, at, number, name = None, 0, 0, ""
        try:
            for batch in batches:
                index: list[tuple] = []
                for i in range(batch.num_rows):
                    page, url, html, digest, kind, refers = (
                        batch.column(c)[i].as_py()
                        for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")
                    )
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(folder, recursive=True)
                        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                        out, at, number = store.open_output_stream(name, compression=None), 0, number + 1
                    # A line break or control character in a URL would end its header line.
                    url = url and re.sub(r"[\x00-\x20\x7f]+", "%20", url)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = member.compress(record_bytes(page, url, html.encode(), digest, refers, kind)) + member.flush()
                    out.write(data)
                    index.append((name, at, len(data), url, digest, page, kind, refers))
                    at += len(data)
                if index:
                    columns = zip(*index, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                    )
        finally:
            if out is not None:
                out.close()

    return rows


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> Archives:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path`` and return the index.

    Of records with equal payloads of at least 100 bytes that with the smallest page_id is a response, the
    others revisit it. NULL html is an empty payload, a NULL url leaves its line out, a NULL page_id
    comes after all others. Of rows that repeat the smallest id and payload one is the response.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"),
    )
    narrow = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "payload_digest")
    shared = settle(
        narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("payload_digest", "first_id", F.lit(True).alias("shared")),
        "warc-shared",
    )
    # By its digest a page meets what is known of it; adaptive execution splits a digest of many pages.
    known = rows.join(shared, "payload_digest", "left")
    first = F.col("shared").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))
    response = F.col("shared").isNull() | first
    typed = known.withColumn("record_type", F.when(response, F.lit("response")).otherwise(F.lit("revisit")))
    # Several rows may have the first id and its payload: one of them is the response.
    firsts = narrow.join(shared, "payload_digest").where(first).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"))
    if not firsts.where("n > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("payload_digest").orderBy("url"))
        one = F.when(F.col("place") == 1, F.lit("response")).otherwise(F.lit("revisit"))
        some = typed.where(first).withColumn("place", place).withColumn("record_type", one).drop("place")
        typed = typed.where(~first).unionByName(some)
    refers = F.when(F.col("record_type") == "revisit", F.col("first_id"))
    wanted = typed.select("page_id", "url", "html", "payload_digest", "record_type", refers.alias("refers_to"))
    return Archives(path, settle(wanted.mapInArrow(_write(path, archive_bytes), INDEX), "warc-index"))


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Merge sorted (offset, length) into reads: start, end and what lies in it."""
    held: list[tuple[int, int]] = []
    start = end = 0
    for offset, length in rows:
        if held and (offset > end + GAP_BYTES or offset + length - start > RANGE_BYTES):
            yield start, end, held
            held = []
        if not held:
            start = offset
        held.append((offset, length))
        end = offset + length
    if held:
        yield start, end, held


def parse_record(data: bytes) -> tuple:
    """page_id, type, refers_to, payload (NULL for a revisit), its digest, url.

    ``data`` is one gzip member; the digest of a response is checked against its bytes.
    """
    data = zlib.decompress(data, 31)
    head, _, block = data.removesuffix(_END.encode()).partition(_END.encode())
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    if lines[0] != "WARC/1.1" or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"no whole record: {lines[0]!r}, {len(block)} bytes")
    number = lambda name: int(fields[name]) if name in fields else None
    payload, digest = None, fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        payload = block.partition(_END.encode())[2]
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
    page = number("WARC-Page-ID")
    return page, fields["WARC-Type"], number("WARC-Refers-To-Page-ID"), payload, digest, fields.get("WARC-Target-URI")


def _read(folder: str):
    names = ["page_id", "record_type", "refers_to", "payload", "payload_digest", "url"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            at = 0
            paths = batch.column("path").to_pylist()
            spots = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            while at < len(paths):
                to = at
                while to < len(paths) and paths[to] == paths[at]:
                    to += 1
                with store.open_input_file(paths[at]) as file:
                    for start, end, within in _ranges(spots[at:to]):
                        data = file.read_at(end - start, start)
                        found = [parse_record(data[o - start : o - start + n]) for o, n in within]
                        columns = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                        )
                at = to

    return rows


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """Records of the index rows in ``selected`` (path, offset, length); see RECORD for the columns.

    Rows of one stretch of an archive meet in one task, sorted by offset, so that their reads merge.
    """
    total = selected.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / F.lit(RANGE_BYTES))
    # By number: index rows are small, and the tasks must follow the bytes that they stand for.
    dealt = selected.select("path", "offset", "length").repartition(1 + total // RANGE_BYTES, "path", stretch)
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(_read(folder), RECORD)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives, read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Size and digest are those of the bytes read, for a revisit those of the record that it refers to. An
    empty table writes no archive and gives an empty table; other columns are ignored.
    """
    path = path or new_path(pages.sparkSession, "warc")
    archives = write_archives(pages, path)
    read = read_records(archives.index, archives.path).select(
        "page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "url"
    )
    read = settle(read, "warc-read")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    responses = read.where("record_type = 'response'").select(*columns)
    # Ids may repeat: the digest says which response of a page is meant.
    whole = responses.select(
        F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")
    ).distinct()
    revisits = read.where("record_type = 'revisit'").join(
        whole, F.col("refers_to").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest"))
    ).withColumn("payload_bytes", F.col("__bytes")).select(*columns)
    return responses.unionByName(revisits)
