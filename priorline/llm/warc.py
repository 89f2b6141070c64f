"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: a task writes its rows as one archive, a gzip member for each record (warcinfo first), under a temporary name
that is then moved; a task run again writes the same bytes to the same name. Of rows with equal payloads (of at least
``revisit_from`` bytes) that with the largest id is a ``response``; the others are ``revisit`` records that name it and
carry no payload. Rows that share that largest id are all responses; a null id counts as the smallest.

Reader: files are cut into byte ranges that do not regard records. A task scans its range for the gzip magic, takes a
place as a member only if it inflates to a WARC header block, and owns the records that start inside its range, reading
past its end where the last one does. Compressed data that looks like a member's start fails the header check.

Files are read and written through ``pyarrow.fs``, by range; the listing goes through Spark's own file systems.
Null html is an empty payload; null urls are written as empty and read back as null.
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

from priorline.llm.common import durable, rows_of, scratch

MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed capture time: the rows have none, and equal input must give equal bytes.
DATE = b"2024-01-01T00:00:00Z"
BLOCK = 1 << 20
#: Digests of several pages that are broadcast (28 bytes each), and tasks that share a digest beyond.
BROADCAST_DIGESTS, SALTS = 500_000, 64
RANGE_BYTES = 32 << 20
#: Bytes of a header block that are inflated at a time, and what each begins with.
HEADER_STEP, START = 1 << 14, b"WARC/1."

RECORD = "start long, type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32(sha1: bytes) -> bytes:
    return base64.b32encode(sha1)


def record_id(page_id: int | None) -> bytes:
    return f"<urn:page:{'' if page_id is None else page_id}>".encode()


def member(fields: list[tuple[bytes, bytes]], body: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = b"\r\n".join([VERSION, *(k + b": " + v for k, v in fields), b"Content-Length: %d" % len(body)])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that names the record that has it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = re.sub(rb"[\r\n]+", b" ", (url or "").encode())
    fields = [(b"WARC-Type", b"revisit" if revisit else b"response"), (b"WARC-Record-ID", record_id(page_id)), (b"WARC-Date", DATE), (b"WARC-Target-URI", target), (b"WARC-Payload-Digest", b"sha1:" + base32(hashlib.sha1(payload).digest()))]
    if revisit:
        fields += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", record_id(refers_to))]
    return member([*fields, (b"Content-Type", b"application/http; msgtype=response")], http if revisit else http + payload)


def with_kinds(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to: null for responses.

    Groups are found on digests alone. The digests that several pages have are broadcast up to ``BROADCAST_DIGESTS`` of
    them, after a count, and payloads stay where they are; beyond, pages of one digest are dealt to ``SALTS`` tasks.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    rows = pages.select("page_id", "url", payload).withColumn("_sha", F.unhex(F.sha1("payload"))).withColumn("_n", F.octet_length("payload"))
    groups = rows.where(F.col("_n") >= revisit_from).groupBy("_sha").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_copies"))
    groups = durable(groups.where("_copies > 1").drop("_copies"), "digests")
    if rows_of(groups) <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(groups), "_sha", "left")
    else:
        dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["_sha", "_salt"], "left")
    later = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top")) & (F.col("_n") >= revisit_from)
    return joined.select("page_id", "url", "payload", F.when(later, F.col("_top")).alias("refers_to"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str, revisit_from: int = 0) -> DataFrame:
    """Archives of ``pages`` (page_id long, url, html) under ``folder``; returns path, records and bytes of each, already written."""

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        draft = f"{place}/.{name}.{uuid.uuid4().hex}"
        n = size = 0
        with store.open_output_stream(draft) as out:
            size += out.write(member([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:archive:" + name.encode() + b">"), (b"WARC-Date", DATE), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    to = refers_to.as_py()
                    size += out.write(record(page_id.as_py(), url.as_py(), payload.as_py(), to, to is not None))
                    n += 1
        store.move(draft, f"{place}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return durable(with_kinds(pages, revisit_from).mapInArrow(run, "path string, records long, bytes long"), "archives")


class Span:
    """Random access to a file from ``at`` on, block by block."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.held = file, at, bytearray()

    def need(self, n: int) -> bytearray:
        """At least ``n`` bytes from ``at`` if the file has them."""
        while len(self.held) < n:
            self.file.seek(self.at + len(self.held))
            more = self.file.read(max(BLOCK, n - len(self.held)))
            if not more:
                break
            self.held += more
        return self.held

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def inflate(span: Span) -> tuple[bytes, int] | None:
    """The gzip member at ``span.at`` and its compressed size. None: no member."""
    z = zlib.decompressobj(31)
    parts, read = [], 0
    try:
        while not z.eof:
            data = span.need(read + BLOCK)[read : read + BLOCK]
            if not data:
                return None
            parts.append(z.decompress(data))
            read += len(data)
    except zlib.error:
        return None
    return b"".join(parts), read - len(z.unused_data)


def starts_record(span: Span) -> bool:
    """Whether the gzip member at ``span.at`` begins with a WARC header block, which is read to its blank line, however long.

    Anything else ends the search at its first bytes or at its first line that is no field.
    """
    z, head, seen, read, data = zlib.decompressobj(31), bytearray(), 0, 0, b""
    try:
        while not z.eof:
            if not data:
                data = bytes(span.need(read + BLOCK)[read : read + BLOCK])
                read += len(data)
                if not data:
                    return False
            head += z.decompress(data, HEADER_STEP)
            data = z.unconsumed_tail
            if not head[: len(START)] == START[: len(head)]:
                return False
            end = head.find(b"\r\n\r\n", max(0, seen - 3))
            if end >= 0:
                return is_header(bytes(head[:end]))
            whole = head.rfind(b"\r\n")  # complete lines end here; the first is the version's
            if whole > seen and any(b":" not in line for line in bytes(head[seen:whole]).split(b"\r\n")[0 if seen else 1 :]):
                return False
            seen = max(seen, whole + 2)
    except zlib.error:
        return False
    return False


def is_header(head: bytes) -> bool:
    """Whether ``head`` is a WARC header block: its version line, and field lines, one of which gives the type."""
    if not head.startswith(START):
        return False
    lines = head.split(b"\r\n")[1:]
    return any(line.lower().startswith(b"warc-type:") for line in lines) and all(b":" in line for line in lines)


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, inflated bytes) of the records that start in [start, end)."""
    span = Span(file, start)
    while span.at < end:
        data = span.need(len(MAGIC) + BLOCK)
        if len(data) < len(MAGIC):
            return
        found = data.find(MAGIC)
        if found < 0:
            span.skip(len(data) - len(MAGIC) + 1)
            continue
        span.skip(found)
        if span.at >= end:
            return
        whole = inflate(span) if starts_record(span) else None
        if whole is None:
            span.skip(1)
            continue
        yield span.at, whole[0]
        span.skip(whole[1])


def parse(raw: bytes) -> dict:
    """Fields and payload of one record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    body = body[: int(fields[b"content-length"])]
    number = lambda v: int(m[1]) if (m := re.match(rb"<urn:page:(-?[0-9]+)>", v)) else None
    out = {"type": fields[b"warc-type"].decode(), "page_id": number(fields.get(b"warc-record-id", b"")), "url": fields.get(b"warc-target-uri", b"").decode() or None, "refers_to": number(fields.get(b"warc-refers-to", b"")), "payload": None, "payload_bytes": None, "payload_digest": None}
    if out["type"] == "warcinfo":
        return out
    http, _, payload = body.partition(b"\r\n\r\n")
    named = re.search(rb"(?i)content-length: *([0-9]+)", http)
    if out["type"] == "response":
        digest = base32(hashlib.sha1(payload).digest())
        if b"sha1:" + digest != fields[b"warc-payload-digest"]:
            raise ValueError(f"payload digest of record {fields[b'warc-record-id']!r} does not match")
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest.decode()}
    return out | {"payload_bytes": int(named[1]), "payload_digest": fields[b"warc-payload-digest"].partition(b":")[2].decode()}


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of ``archives`` (path string, bytes long) but for warcinfo, with path and start; without payloads on request."""
    spans = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("from"))
    spans = spans.select("path", "from", F.least(F.col("from") + range_bytes, F.col("bytes")).alias("to"))
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "from", "to")), strict=True):
                store, place = _store(path)
                rows, held = [], 0
                with store.open_input_file(place) as file:
                    for at, raw in members(file, start, end):
                        one = parse(raw)
                        if one["type"] == "warcinfo":
                            continue
                        if not payloads:
                            one["payload"] = None
                        rows.append(one | {"path": path, "start": at})
                        held += len(one["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, min(spans.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism * 64))
    return spans.repartition(n).mapInArrow(run, f"path string, {RECORD}")


def round_trip(pages: DataFrame, revisit_from: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back."""
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, revisit_from), range_bytes, payloads=False)
