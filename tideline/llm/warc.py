"""WARC archives written from pages and read back as a chunked record table."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import spread
from tideline.session import materialise, shared_table_path

#: Largest piece of a payload that is held at once.
CHUNK_BYTES = 1 << 18
#: Tasks that the pages of one payload are dealt to.
SALTS = 16
_DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
CHUNKS = "archive string, record_no long, record_id string, page_id long, record_type string, refers_to long, payload_bytes long, declared_digest string, chunk_no int, last boolean, data binary, digest string"


def payload_digest(state) -> str:
    return base64.b32encode(state.digest()).decode()


def _header_value(text: str | None) -> str:
    """A value that cannot end its header line early: controls and non-ASCII are percent-encoded."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def _record(page_id, url, payload: bytes | None, declared: str, size: int, refers_to) -> Iterator[bytes]:
    """One record in pieces; a revisit (payload None) carries the headers of its response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "none" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_header_value(url) or f'urn:page:{name}'}", f"WARC-Payload-Digest: sha1:{declared}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload or b'')}",
    ]
    if payload is None:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    yield ("\r\n".join(lines) + "\r\n\r\n").encode() + http
    for start in range(0, len(payload or b""), CHUNK_BYTES):
        yield payload[start : start + CHUNK_BYTES]
    yield b"\r\n\r\n"


def with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set where a larger id has the payload.

    The join partner is a few small rows for each payload that several pages share, and none for others. A
    payload crosses one shuffle with its page, salted, so that one of a third of all pages is dealt to
    several tasks.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    shared = rows.groupBy("sha1").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    # an id found twice is the original both times; pages without an id refer to one that has an id
    return rows.join(shared, ["sha1", "salt"], "left").drop("salt").withColumn(
        "refers_to", F.when(F.col("original") > F.coalesce("page_id", F.lit(-(2**63))), F.col("original")))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one gzip member per record into archives under ``folder``; the manifest names them.

    ``pages`` has page_id, url, html. Each task attempt writes a file of its own name and reports it in
    its output rows, so the manifest, which Spark commits, holds each record once even when attempts
    are repeated. Returns the manifest: (archive, records, bytes). A NULL html is an empty payload.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        records = size = 0
        out = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, sha1, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                body = None if refers_to is not None else payload
                for piece in _record(page_id, url, body, base64.b32encode(sha1).decode(), len(payload), refers_to):
                    size += out.write(zipped.compress(piece))
                size += out.write(zipped.flush())
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

    # a row for each task, gathered in one file: a repeated attempt then replaces its row or is not read at all
    return materialise(with_originals(pages).mapInArrow(write, MANIFEST).repartition(1))


class _Inflated:
    """Bytes of a file of gzip members, read and inflated piece by piece."""

    def __init__(self, stream):
        self.stream, self.left, self.ready, self.inflate = stream, b"", b"", None

    def more(self) -> bool:
        while True:
            if not self.left:
                self.left = self.stream.read(CHUNK_BYTES)
                if not self.left:
                    return False
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            piece = self.inflate.decompress(self.left, CHUNK_BYTES)
            self.left = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.left, self.inflate = self.inflate.unused_data, None
            if piece:
                self.ready += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark; a header is as long as the url that it holds."""
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not self.more():
                return None
        head, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return head

    def pieces(self, size: int, step: int) -> Iterator[bytes]:
        while size:
            want = min(size, step)
            while len(self.ready) < want:
                if not self.more():
                    raise ValueError("a WARC record is cut short")
            piece, self.ready = self.ready[:want], self.ready[want:]
            size -= want
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def archive_chunks(stream, archive: str, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> Iterator[dict]:
    """Rows of the chunked record table of one archive; no record is ever held whole.

    Every record gives at least one chunk. ``digest`` is the SHA-1 of the payload up to the end of the
    chunk, so that of the last chunk is the payload's own; a response whose payload differs from its
    declared digest is an error. A revisit gives one empty chunk with its declared digest and length.
    """
    source, number = _Inflated(stream), 0
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        length = int(fields["content-length"])
        http = source.until(b"\r\n\r\n")
        inner = _fields(http)
        left = length - len(http) - 4
        declared = fields["warc-payload-digest"].removeprefix("sha1:")
        row = {
            "archive": archive, "record_no": number, "record_id": fields["warc-record-id"], "page_id": _page(fields["warc-record-id"]),
            "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")), "declared_digest": declared,
            "payload_bytes": int(inner["content-length"]) if fields["warc-type"] == "revisit" else left,
        }
        state, chunk = hashlib.sha1(), 0
        done = 0
        for piece in source.pieces(left, chunk_bytes):
            state.update(piece)
            done += len(piece)
            yield row | {"chunk_no": chunk, "last": done == left, "data": piece if data else None, "digest": payload_digest(state)}
            chunk += 1
        if not left:
            yield row | {"chunk_no": 0, "last": True, "data": b"" if data else None,
                         "digest": declared if fields["warc-type"] == "revisit" else payload_digest(state)}
        if fields["warc-type"] == "response" and payload_digest(state) != declared:
            raise ValueError(f"{archive}: record {number} does not have its declared digest")
        if b"".join(source.pieces(4, 4)) != b"\r\n\r\n":
            raise ValueError(f"{archive}: record {number} does not end where it should")
        number += 1


def read_archives(manifest: DataFrame, folder: str, *, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names, streamed file by file."""
    schema = pa.schema([
        ("archive", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()),
        ("data", pa.binary()), ("digest", pa.string()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(archive, compression=None) as stream:
                    for row in archive_chunks(stream, archive, chunk_bytes, data):
                        rows.append(row)
                        held += len(row["data"] or b"")
                        if len(rows) >= 2000 or held >= 8 * chunk_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("archive").repartition(spread(manifest.sparkSession), F.xxhash64("archive"))
    return files.mapInArrow(read, CHUNKS)


def archived_pages(pages: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write pages to archives, read them back, and give one row per record.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). Of equal payloads, empty ones
    included, the record with the largest page_id is the response and others revisit it; rows that
    repeat the largest id are all responses, NULL ids are smaller than any other, and equal payloads
    without any id are all responses. A url of any length is kept in its record's header, which is the one
    part of a record that is held whole; a NULL one is named after the page. No rows give no archives and no
    rows; other columns are not read.
    """
    folder = shared_table_path(pages.sparkSession, "warc")
    folder = folder if ":" in folder else f"file://{folder}"
    chunks = read_archives(write_archives(pages, folder), folder, chunk_bytes=chunk_bytes, data=False)
    return chunks.where("last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
