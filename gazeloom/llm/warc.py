"""WARC archives: written as one gzip stream per file, then normalised to one gzip member per record with an offset index.

Archives are rows (archive, content); real files come the same way from ``spark.read.format("binaryFile")``. The normaliser inflates a file's stream once, in
pieces, cuts it at the records' Content-Length, compresses every record as a member of its own, and writes a sidecar: one line of JSON per record with
offset and length. Reading back seeks each record by its sidecar line and inflates that member alone.

Equal payloads are found on digests alone: pre-aggregated counts, and a join with the repeated digests only. A revisit carries headers, no payload.
"""
from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from gazeloom.llm.common import materialise

#: Bytes of records in a written archive, before compression; a larger record has an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Payloads below this size are always responses.
LEAST_REVISIT = 100
#: Compressed bytes inflated at a time.
STEP = 1 << 18
GZIP = 31
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class Damaged(ValueError):
    """An archive that is no gzip stream of WARC records, or ends inside one."""


def record_id(page_id, digest: str) -> str:
    """The same for every record of a page and payload, so that revisits can name one they have not seen."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def quoted(url: str) -> str:
    """White space and control characters, which would end a header line, percent-encoded."""
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with the payload, or a revisit of ``refers_to`` without. HTTP headers keep the payload's length either way."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own = record_id(page_id, digest) if refers_to is None else f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/revisit').urn}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {quoted(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line is the version."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged(f"no WARC record begins with {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:] if x)}


def inflate(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file, one member or several, a piece at a time."""
    view, at = memoryview(content), 0
    stream = zlib.decompressobj(GZIP)
    try:
        while at < len(view):
            piece = view[at: at + STEP]
            at += len(piece)
            yield stream.decompress(piece)
            while stream.eof and stream.unused_data:
                rest, stream = stream.unused_data, zlib.decompressobj(GZIP)
                yield stream.decompress(rest)
            if stream.eof and at < len(view):
                stream = zlib.decompressobj(GZIP)
    except zlib.error as e:
        raise Damaged(f"no gzip stream: {e}") from e
    if content and not stream.eof:
        raise Damaged("the gzip stream ends early")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of a gzip file; holds one record and one piece of the stream."""
    held, need, found = bytearray(), 0, {}
    for piece in inflate(content):
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                found = headers(bytes(held[:end]))
                try:
                    need = end + 4 + int(found["content-length"]) + 4
                except (KeyError, ValueError) as e:
                    raise Damaged("a record without Content-Length") from e
            if len(held) < need:
                break
            yield found, bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise Damaged("the file ends inside a record")


def normalised(content: bytes) -> tuple[bytes, bytes]:
    """A gzip file of WARC records -> the same records as one member each, and the sidecar index."""
    out, index = bytearray(), []
    for found, whole in records(content):
        pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        member = pack.compress(whole) + pack.flush()
        index.append(json.dumps({"offset": len(out), "length": len(member), "type": found.get("warc-type"), "id": found.get("warc-record-id"),
                                 "url": found.get("warc-target-uri"), "digest": found.get("warc-payload-digest")}))
        out += member
    return bytes(out), "\n".join(index).encode()


def looked_up(content: bytes, line: str) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record that a sidecar line names, from its member alone."""
    at = json.loads(line)
    whole = zlib.decompress(content[at["offset"]: at["offset"] + at["length"]], GZIP)
    end = whole.index(b"\r\n\r\n")
    found = headers(whole[:end])
    return found, whole[end + 4: end + 4 + int(found["content-length"])]


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the smallest page_id with an equal payload, null where the row is its response."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast(BinaryType())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    repeated = (rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1 and first is not null").select("digest", "first"))
    repeated = materialise(repeated, "repeated")  # its size is known from here on: the join is planned by it
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, size: int | None = None) -> DataFrame:
    """(archive, content): gzip files, each a single stream of about ``size`` bytes of records (ARCHIVE_BYTES), in the order of the rows."""
    size = size or ARCHIVE_BYTES

    def write(batches):
        task, number = TaskContext.get().partitionId(), 0
        stream, parts, held = zlib.compressobj(6, zlib.DEFLATED, GZIP), [], 0

        def closed():
            content = b"".join([*parts, stream.flush()])
            return pa.RecordBatch.from_pydict({"archive": pa.array([f"{task:06d}-{number:06d}.warc.gz"]), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                whole = record(*(x.as_py() for x in row))
                if held and held + len(whole) > size:
                    yield closed()
                    stream, parts, held, number = zlib.compressobj(6, zlib.DEFLATED, GZIP), [], 0, number + 1
                parts.append(stream.compress(whole))
                held += len(whole)
        if held:
            yield closed()

    return decided(pages).mapInArrow(write, "archive string, content binary")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content, sidecar) of each gzip file (archive, content): a member per record, and a line of JSON per record with its offset and length.

    Files of one stream, of several or already of a member per record all give the same. A null or empty file stays empty. A file that is cut off or
    no gzip of WARC records is an error, as an index of part of it would hide the rest. Memory: the file, its result and one record.
    """

    def rewrite(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content")):
                try:
                    new, sidecar = normalised(content.as_py() or b"")
                except Damaged as e:
                    raise Damaged(f"{name}: {e}") from e
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name.as_py()], pa.string()), "content": pa.array([new], pa.binary()), "sidecar": pa.array([sidecar], pa.binary())})

    return archives.select(F.col("archive").cast("string").alias("archive"), "content").mapInArrow(rewrite, "archive string, content binary, sidecar binary")


def read_records(normal: DataFrame) -> DataFrame:
    """A row per record of normalised archives, each found by its sidecar line: archive, offset, page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    A response's size and digest are taken from its payload, which must match its headers; a revisit has them from its headers.
    """

    def read(batches):
        for batch in batches:
            for name, content, sidecar in zip(batch.column("archive").to_pylist(), batch.column("content"), batch.column("sidecar")):
                data, out = content.as_py(), []
                for line in sidecar.as_py().decode().split("\n") if len(data) else ():
                    found, block = looked_up(data, line)
                    end = block.index(b"\r\n\r\n") + 4
                    stated = int(re.search(rb"\r\nContent-Length: (\d+)", block[:end])[1])
                    digest = found["warc-payload-digest"].removeprefix("sha256:")
                    if found["warc-type"] == "response" and (len(block) - end != stated or hashlib.sha256(block[end:]).hexdigest() != digest):
                        raise Damaged(f"{name}: {found['warc-record-id']} is not what its headers say")
                    number = lambda k: int(found[k]) if k in found else None
                    out.append({"archive": name, "offset": json.loads(line)["offset"], "page_id": number("x-page-id"), "url": found.get("warc-target-uri"),
                                "record_type": found["warc-type"], "payload_bytes": stated, "payload_digest": digest, "refers_to": number("x-refers-to-page-id")})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                        [("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]))

    return normal.mapInArrow(read, "archive string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of ``pages`` (page_id, url, html) after writing, normalising and reading back; all three are stored in between.

    One record per row. Null html is an empty payload, a null url is left out, a null page_id has no number in its record. Of equal payloads of LEAST_REVISIT bytes
    or more the smallest page_id is the response and other ids revisit it; rows that repeat that page_id are responses too, as are equal payloads of which no row has an id.
    Other columns do not travel. An empty table has no records.
    """
    archives = materialise(write_archives(pages), "archives")
    return read_records(materialise(normalise(archives), "normalised"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes from pages),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes, payload_digest, case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from f
"""
