"""WARC archives written and read as a table of record chunks.

Tasks write gzip members, one record each, into files of bounded size in a shared folder, and name
them in a manifest; files of attempts that failed are in no manifest and so are never read. Reading
turns records into rows (record, chunk number) with the SHA-1 of all bytes so far: no record is ever
held as a whole, however large its payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.session import cut_lineage, fresh_path

CHUNK = 1 << 20
FILE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
CHUNKS = "page_id long, record_type string, refers_to long, url string, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else "none"
    return None if number == "none" else int(number)


def _header(page_id, url, kind: str, refers_to, digest: str, size: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}",
            f"X-Payload-Length: {size}",
        ]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size if kind == 'response' else 0}", "", ""]
    return "\r\n".join(lines).encode()


def elect_responses(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, html, first): ``first`` is the smallest id of the pages with the same payload,
    where that is another page's id and the payload has ``least_bytes`` at least, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    shared = (
        keyed.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "size", "first")
    )
    return keyed.join(shared, ["digest", "size"], "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    )


def write_warc(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the manifest (path, records).

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest id are
    responses and the others revisits of it. A null payload is empty; a null id is written as none
    and is never referred to. The manifest is a written table.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, done = None, "", 0, []
        for batch in batches:
            for page_id, url, html, first in zip(*batch.columns, strict=True):
                if out is None:
                    system, root = fs.FileSystem.from_uri(folder)
                    system.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, records = system.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0
                payload = html.as_buffer()
                digest = hashlib.sha1()
                for at in range(0, payload.size, CHUNK):
                    digest.update(payload.slice(at, min(CHUNK, payload.size - at)))
                kind = "response" if first.as_py() is None else "revisit"
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                header = _header(page_id.as_py(), url.as_py(), kind, first.as_py(), base32(digest.digest()), payload.size)
                out.write(member.compress(header))
                if kind == "response":
                    for at in range(0, payload.size, CHUNK):
                        out.write(member.compress(payload.slice(at, min(CHUNK, payload.size - at))))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                records += 1
                if out.tell() >= file_bytes:
                    out.close()
                    out, done = None, [*done, (path, records)]
        if out is not None:
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return cut_lineage(elect_responses(pages, least_bytes).mapInArrow(write, "path string, records long"))


class _Inflated:
    """Bytes of the members of a gzip file, read forward in small pieces."""

    def __init__(self, source):
        self.source, self.inflate, self.rest, self.left = source, zlib.decompressobj(31), b"", b""

    def read(self, most: int) -> bytes:
        """Up to ``most`` bytes; empty at the end of the file."""
        while not self.left:
            if self.inflate.eof:
                self.rest = self.inflate.unused_data or self.rest
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.unconsumed_tail or self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not data:
                return b""
            self.left = self.inflate.decompress(data, CHUNK)
        got, self.left = self.left[:most], self.left[most:]
        return got

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            got = self.read(n)
            if not got:
                raise ValueError("the archive ends within a record")
            parts.append(got)
            n -= len(got)
        return b"".join(parts)

    def header(self) -> dict[str, str] | None:
        text = b""
        while not text.endswith(b"\r\n\r\n"):
            got = self.read(1 << 16)
            if not got:
                if text:
                    raise ValueError("the archive ends within a header")
                return None
            text += got
            end = text.find(b"\r\n\r\n")
            if end >= 0:
                self.left = text[end + 4 :] + self.left
                text = text[: end + 4]
        lines = text.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        return dict(line.split(": ", 1) for line in lines[1:] if line)


def _records(source, chunk: int) -> Iterator[tuple]:
    stream = _Inflated(source)
    while (head := stream.header()) is not None:
        kind, size = head["WARC-Type"], int(head["Content-Length"])
        want = head["WARC-Payload-Digest"].removeprefix("sha1:")
        full = int(head.get("X-Payload-Length", size))
        fixed = (_page(head["WARC-Record-ID"]), kind, _page(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"))
        digest, at, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.exactly(min(chunk, size - at))
            digest.update(data)
            at += len(data)
            so_far = base32(digest.copy().digest())
            last = at == size
            if last and kind == "response" and so_far != want:
                raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
            yield *fixed, number, data, at, so_far, last, full, want
            if last:
                break
            number += 1
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_chunks(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in ``manifest``.

    A row per record and chunk number (an empty payload has one empty chunk): id, type, the page that
    a revisit refers to, url, chunk bytes, bytes and base32 SHA-1 up to and with this chunk,
    whether it is the last, and the size and digest of the full payload as the header has them.
    Bytes after a damaged place, wrong lengths and wrong digests are errors.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()),
        ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_stream(name, compression=None) as source:
                    for row in _records(source, chunk):
                        rows.append(row)
                        size += len(row[5]) + 200
                        if size >= BATCH_BYTES:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    files = manifest.count()
    return manifest.select("path").repartition(max(1, files)).mapInArrow(read, CHUNKS)


def read_back(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives of ``pages``."""
    chunks = read_chunks(write_warc(pages, least_bytes), chunk).where("last")
    of_response = F.col("record_type") == "response"
    return chunks.select(
        "page_id", F.when(of_response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(of_response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
