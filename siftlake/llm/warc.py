"""WARC archives: writing, normalising whole-file gzip, reading by offset.

Archives are first written as one gzip stream over all records of a file.  The
normaliser inflates such a stream once, cuts it into records by their
Content-Length, writes each as a gzip member of its own and a sidecar index with
a line for each record (offset, length, type, record id); readers then seek.

A record is a `response` with HTTP headers and payload or, where another page
has the same payload and a larger id, a `revisit` that keeps the HTTP headers
and digest, refers to that page's record and has no payload.  A null payload is
empty; pages without an id count as smaller than all; rows that repeat the
largest id are all responses.  Ids are numbers of 64
bits or their decimal text; other text ends the job with an error.  Names are unique to each attempt of a task, and
only reported ones are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import shared
from siftlake.llm.text import strings
from siftlake.llm.tokenpack import store

PIECE, LEVEL, DATE = 1 << 20, 3, "2000-01-01T00:00:00Z"

#: Payloads with copies whose table (some hundred bytes a row) is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _safe(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """The bytes of one WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one or more members, read once."""
    engine = zlib.decompressobj(31)
    while data := source.read(PIECE):
        while data:
            yield engine.decompress(data, PIECE * 4)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, PIECE * 4)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
            else:
                break


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, cut by their Content-Length."""
    held, need, start = bytearray(), None, 0
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[start:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[start:need])
            start, need = need, None
        if start:
            del held[:start]
            need, start = None if need is None else need - start, 0
    if held:
        raise ValueError("the last record is cut short")


def normalise(source: str, target: str) -> int:
    """Rewrites a whole-file stream with one gzip member for each record, and target.idx; the number of records."""
    fs, path = store(source)
    to_fs, to = store(target)
    n = at = 0
    with fs.open_input_stream(path, compression=None) as raw, to_fs.open_output_stream(to, compression=None) as out, to_fs.open_output_stream(to + ".idx") as index:
        for data in records(inflate(raw)):
            h = headers(data[: data.index(b"\r\n\r\n")])
            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = engine.compress(data) + engine.flush()
            out.write(member)
            index.write(f"{at} {len(member)} {h['warc-type']} {h['warc-record-id']}\n".encode())
            at += len(member)
            n += 1
    return n


def read_at(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(WARC headers, block) of the record whose member stands there."""
    data = zlib.decompress(file.read_at(length, offset), 31)
    end = data.index(b"\r\n\r\n")
    h = headers(data[:end])
    return h, data[end + 4 : end + 4 + int(h["content-length"])]


def _page(urn: str | None) -> int | None:
    value = (urn or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if value == "none" else int(value)


def write_archives(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes whole-file gzip archives of all rows; (uri, n) of the files. Payloads under `least` bytes are never revisits."""
    spark = pages.sparkSession
    body = F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary")  # bytes that are no UTF-8 stay as they are
    given = pages.select(pages[id].cast("long").alias("id"), pages[url].cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("sha1"))
    twice = given.where(F.octet_length("body") >= least).groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    twice = shared.written(twice.select("sha1", "first"), "copies")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    few = twice.count() <= BROADCAST_ROWS
    rows = given.join(F.broadcast(twice) if few else twice, "sha1", "left").select("id", "url", "body", "sha1", refers.alias("refers"))
    to = shared.fresh(spark, "warc")

    def run(batches):
        n, out, engine = 0, None, None
        uri = f"{to}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for i, u, b, s, r in zip(*(strings(c) for c in batch.columns), strict=True):
                if out is None:
                    fs, path = store(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, engine = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(engine.compress(record(i, u, b, r, base32(bytes.fromhex(s)))))
                n += 1
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["uri", "n"])

    return shared.written(rows.mapInArrow(run, "uri string, n long"), "archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Normalises each file of archives (uri); (uri, n) of the new files, with sidecars uri.idx."""
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                to = uri.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.members.warc.gz"
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([normalise(uri, to)], pa.int64())], ["uri", "n"])

    spread = archives.select("uri").repartition(shared.partitions(archives.sparkSession), "uri")
    return shared.written(spread.mapInArrow(run, "uri string, n long"), "members")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record, read by its offset; a response's digest is taken from its payload anew."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = store(uri)
                with fs.open_input_stream(path + ".idx") as f:
                    entries = [x.split(b" ") for x in f.read().splitlines()]
                rows = []
                with fs.open_input_file(path) as file:
                    for offset, length, *_ in entries:
                        h, block = read_at(file, int(offset), int(length))
                        end = block.index(b"\r\n\r\n") + 4
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response":
                            size, found = len(block) - end, base32(hashlib.sha1(memoryview(block)[end:]).digest())
                            if found != digest:
                                raise ValueError(f"a payload in {uri} at {int(offset)} differs from its digest")
                        else:
                            size = int(headers(block[: end - 4])["content-length"])
                        rows.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), size, digest, h["warc-type"], _page(h.get("warc-refers-to")), block[end:])[: len(names)])
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    spread = archives.select("uri").repartition(shared.partitions(archives.sparkSession), "uri")
    return spread.mapInArrow(run, schema)
