"""WARC archives written and read as a chunked record table.

A payload travels as rows (record, chunk number, chunk): writer and reader
hold one chunk of a record at a time, never the record, and each chunk row read
back carries the digest of the payload up to and with that chunk.

Archives are ``.warc.gz`` files (one gzip member per record) below a folder
that all executors share.  Each task writes files named after itself and
reports them in a manifest, which alone is read: what a lost or repeated task
left behind is in no manifest.  Of records with equal payloads of ``least``
bytes or more the one with the smallest id is the response, others are revisits
without payload.

Defined cases: a null payload is empty; a null page id gets the record id
``<urn:page:null>`` and is a response; repeated rows are records of their own,
and those that share the response's id and payload are responses too; a null
url is left out, line breaks in one are percent-encoded; an empty table gives
an empty manifest and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.joins import sized
from txnrisk.session import checkpoint_dir, cut_lineage

CHUNK_BYTES = 1 << 18
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNKS = ("path string, record long, record_id string, record_type string, uri string, refers_to string, "
          "declared_digest string, payload_bytes long, chunk_no long, chunk binary, digest string")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bytes are four times 40 bits, and 40
    bits are 8 digits."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    return pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("uri"),
                        payload.alias("payload"), base32_sha1(payload).alias("digest"),
                        F.octet_length(payload).cast("long").alias("n"))


def revisits(pages: DataFrame, least: int = 0, page: str = "page_id", url: str = "url",
             html: str = "html") -> DataFrame:
    """``(page_id, digest, refers_to)`` of the records that repeat one with a smaller id."""
    rows = cut_lineage(_records(pages, page, url, html).select("page_id", "digest", "n"), "warc-digests")
    first = rows.filter(F.col("n") >= least).groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return rows.join(sized(first), "digest").filter(F.col("page_id") > F.col("refers_to")).select(
        "page_id", "digest", "refers_to").distinct()


def _header(page_id, uri, digest, n, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    body = len(http) + (n if refers_to is None else 0)
    named = lambda x: f"<urn:page:{'null' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {named(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, page: str = "page_id",
                   url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row below ``folder`` (by default in the shared
    folder) and return the manifest table ``(path, records, bytes)``."""
    folder = folder or os.path.join(checkpoint_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    again = revisits(pages, least, page, url, html)
    rows = _records(pages, page, url, html).join(
        sized(again), ["page_id", "digest"], "left").withColumn(
        "payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / CHUNK_BYTES)).cast("int")
    # numbers first, then each row cuts its own chunk: never all chunks of a payload at once
    rows = rows.select("page_id", "uri", "digest", "n", "refers_to", "payload", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    rows = rows.withColumn("chunk", F.substring("payload", F.col("chunk_no") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES))).drop("payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        out, made = None, []

        def close() -> None:
            if out is not None:
                out.close()

        gz = sha = None
        left, want = 0, ""
        for b in batches:
            ids, uris, digests, sizes, refs, nos = (b.column(i).to_pylist() for i in range(6))
            chunks = b.column(6)
            for i, no in enumerate(nos):
                if no == 0:
                    if out is None or made[-1][2] >= FILE_BYTES:
                        close()
                        name = f"{top}/{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(name, compression=None)
                        made.append([name, 0, 0])
                    gz, sha = zlib.compressobj(1, wbits=31), hashlib.sha1()
                    left, want = (sizes[i], digests[i]) if refs[i] is None else (0, None)
                    made[-1][1] += 1
                    head = gz.compress(_header(ids[i], uris[i], digests[i], sizes[i], refs[i]))
                    out.write(head)
                    made[-1][2] += len(head)
                data = chunks[i].as_buffer()
                sha.update(data)
                left -= data.size
                z = gz.compress(data)
                if left <= 0:  # the last chunk
                    if want and b32encode(sha.digest()).decode() != want:
                        raise ValueError(f"payload of page {ids[i]} does not match its digest")
                    z += gz.compress(b"\r\n\r\n") + gz.flush()
                out.write(z)
                made[-1][2] += len(z)
        close()
        if made:
            cols = [*zip(*made)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.int64())], ["path", "records", "bytes"])

    return cut_lineage(rows.mapInArrow(run, MANIFEST), "warc-manifest")


class Feed:
    """Bytes of a gzip file of many members, taken line by line or in pieces."""

    def __init__(self, stream, step: int = CHUNK_BYTES):
        self.stream, self.step, self.gz, self.raw, self.buf = stream, step, zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        while True:
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            raw = self.raw or self.stream.read(self.step)
            if not raw:
                return False
            out = self.gz.decompress(raw, self.step)
            self.raw = self.gz.unconsumed_tail
            if out:
                self.buf += out
                return True

    def line(self) -> bytes | None:
        seen = 0
        while (at := self.buf.find(b"\r\n", seen)) < 0:
            seen = max(0, len(self.buf) - 1)
            if not self.more():
                return None
        out = bytes(self.buf[:at])
        del self.buf[:at + 2]
        return out

    def take(self, n: int) -> bytes:
        """``n`` bytes at most, at least one."""
        if not self.buf and not self.more():
            raise EOFError("the archive ends within a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def head(self) -> list[bytes]:
        lines = []
        while (x := self.line()):
            lines.append(x)
        return lines


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.decode().split(":", 1) for x in lines[1:])}


def _chunk_rows(feed: Feed, path: str) -> Iterator[tuple]:
    record = 0
    while lines := feed.head():
        warc, http = _fields(lines), _fields(feed.head())
        kind, n = warc["warc-type"], int(http["content-length"])
        fixed = (path, record, warc["warc-record-id"], kind, warc.get("warc-target-uri"), warc.get("warc-refers-to"),
                 warc["warc-payload-digest"].removeprefix("sha1:"), n)
        sha, left, no = hashlib.sha1(), n if kind == "response" else 0, 0
        while True:
            data = feed.take(min(left, CHUNK_BYTES)) if left else b""
            sha.update(data)
            left -= len(data)
            digest = b32encode(sha.digest()).decode() if kind == "response" else None
            yield (*fixed, no, data, digest)
            no += 1
            if not left:
                break
        if feed.line() != b"" or feed.line() != b"":
            raise ValueError(f"record {record} of {path} does not end as it should")
        record += 1


def read_archives(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """Chunk rows (``CHUNKS``) of the archives that ``manifest`` names; the
    last chunk's ``digest`` is that of the whole payload.  Revisits have one
    empty chunk and no digest of their own."""
    schema = pa.schema([("path", pa.string()), ("record", pa.int64()), ("record_id", pa.string()),
                        ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
                        ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int64()),
                        ("chunk", pa.binary()), ("digest", pa.string())])
    where = folder or checkpoint_dir(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        fs, _ = FileSystem.from_uri(where)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in _chunk_rows(Feed(stream), path):
                        rows.append(row)
                        held += len(row[9]) + 200
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # a file is read by one task: deal files out evenly, largest spread by path
    files = manifest.select("path")
    files = files.repartition(max(1, min(files.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism,
                                         10_000)), "path")
    return files.mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: ``(page_id, payload_bytes, payload_digest,
    record_type, refers_to)``.  Bytes and digest of a response come from the
    chunks, those of a revisit from its header."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("null")).cast("long")
    one = chunks.withColumn("size", F.octet_length("chunk").cast("long")).groupBy("path", "record").agg(
        F.first("record_id").alias("record_id"), F.first("record_type").alias("record_type"),
        F.first("refers_to").alias("refers_to"), F.first("declared_digest").alias("declared"),
        F.first("payload_bytes").alias("length"), F.sum("size").alias("read"),
        F.max_by("digest", "chunk_no").alias("digest"))
    response = F.col("record_type") == "response"
    return one.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(response, F.col("read")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("declared")).alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"))
