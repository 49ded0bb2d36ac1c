"""WARC archives: a writer of gzip members and a splittable reader.

The writer gives each record a gzip member of its own, and a revisit record to every page whose payload equals that of
another page. Its manifest is an ordinary table, so only archives of tasks that succeeded are ever read. A reader task gets
a byte range, looks for gzip magic, accepts a candidate whose member starts with a WARC header and ends where a next member
or the file's end is, and owns the records that start inside the range, reading on beyond it for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from matchloom.llm.common import counted_stage, map_rows, new_path, stage

#: Payloads of fewer bytes are never revisits. Bytes of a byte range, and of an archive before the next is begun.
LEAST_REVISIT = 1000
RANGE = 8 << 20
ARCHIVE = 256 << 20
#: Rows of 40-byte digests and ids that may be broadcast: about 50 MB.
BROADCAST_DIGESTS = 500_000
_MAGIC = b"\x1f\x8b\x08"
_READ = 256 << 10


def _record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join(f"%{b:02X}" if b <= 32 or b > 126 else chr(b) for b in (url or "").encode("utf-8", "surrogatepass"))
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, html and refers_to: for pages whose payload of at least ``least`` bytes a page of larger id has too, that largest id.

    Payloads are compared by digest on rows of digest and page_id alone. The table of digests that occur again is broadcast
    if it has at most ``most`` rows, so that html stays where it was read; beyond that the pages are dealt by digest, where
    adaptive execution splits a digest that a third of the pages share. A null html is empty. A null page_id refers to the
    largest id of its payload if there is one; rows of one repeated page_id don't refer to themselves: of the largest id,
    every row is a response.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    large = pages.select("page_id", "url", "html", F.when(F.octet_length(data) >= least, F.sha1(data)).alias("same"))
    narrow = large.where("same is not null").select("same", "page_id")
    twice = narrow.groupBy("same").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1 and largest is not null")
    twice, n = counted_stage(twice.drop("n"), "payloads")
    own = F.concat(F.lit("own-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("-"), F.crc32(F.encode(F.coalesce("url", F.lit("")), "UTF-8")).cast("string"))
    joined = large.withColumn("same", F.coalesce("same", own)).join(F.broadcast(twice) if n <= most else twice, "same", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, html, refers_to rows to ``folder``; gives the manifest: path, bytes, records.

    ``folder`` is a URI that all executors share. Each task writes files of its own under fresh names. Rows are written as
    they come: a null html is empty, a null page_id has an empty record id, a repeated row is written again, a record is held
    whole in memory. No rows give an empty manifest.
    """
    schema = T._parse_datatype_string("path string, bytes long, records long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        out, path, n, done = None, "", 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, out, n = f"{folder}/{name}", system.open_output_stream(f"{root}/{name}", compression=None), 0
                    kind = "response" if refers_to is None else "revisit"
                    out.write(_gzip(_record(kind, page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)))
                    n += 1
                    if out.tell() >= ARCHIVE:
                        done.append((path, out.tell(), n))
                        out.close()
                        out = None
        if out is not None:
            done.append((path, out.tell(), n))
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, schema)


def filesystem(uri: str):
    """(file system, path in it) of a URI as Spark writes it.

    The names that only Hadoop has for a store are mapped to those of the Arrow file systems: s3a and s3n to s3, dbfs to its
    mount /dbfs. A scheme that no Arrow file system has raises a ValueError that names it.
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest if colon else uri)
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    except pa.ArrowInvalid as e:
        raise ValueError(f"archives can't be kept at {uri}: no file system for {scheme}:") from e


class _Buffer:
    """Bytes of a file from a position on, read as they are needed."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.start, self.data = file, size, start, bytearray()
        file.seek(start)

    def reach(self, end: int) -> None:
        end = min(end, self.size)
        while self.start + len(self.data) < end:
            got = self.file.read(max(_READ, end - self.start - len(self.data)))
            if not got:
                break
            self.data += got

    def drop(self, before: int) -> None:
        del self.data[: before - self.start]
        self.start = before


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records whose gzip members start in [start, end) of an open file of ``size`` bytes."""
    buffer, at = _Buffer(file, size, start), start
    while at < end:
        buffer.reach(at + _READ)
        found = buffer.data.find(_MAGIC, at - buffer.start)
        if found < 0:
            reached = buffer.start + len(buffer.data)
            if reached >= size or reached >= end + len(_MAGIC):
                return
            at = max(at, reached - len(_MAGIC) + 1)
            buffer.drop(at)
            continue
        at = buffer.start + found
        if at >= end:
            return
        buffer.drop(at)
        got = _member(buffer, size)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at += got[1]
        buffer.drop(at)


def _member(buffer: _Buffer, size: int) -> tuple[bytes, int] | None:
    """The record that the buffer's member holds and the member's length, or None if it is no WARC record."""
    d, out, fed = zlib.decompressobj(31), bytearray(), 0
    try:
        while not d.eof:
            buffer.reach(buffer.start + fed + _READ)
            part = bytes(buffer.data[fed : fed + _READ])
            if not part:
                return None
            out += d.decompress(part)
            fed += len(part)
            if not b"WARC/1.".startswith(out[:7]):
                return None
    except zlib.error:
        return None
    length = fed - len(d.unused_data)
    buffer.reach(buffer.start + length + len(_MAGIC))
    after = bytes(buffer.data[length : length + len(_MAGIC)])
    if not out.startswith(b"WARC/1.") or b"\r\n\r\n" not in out or not (after == _MAGIC or buffer.start + length >= size):
        return None
    return bytes(out), length


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def _page(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(n) if n else None


def read_archives(manifest: DataFrame, split: int = RANGE, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest`` (path, bytes): page_id, record_type, target_uri, refers_to, payload_bytes, payload_digest[, payload].

    The digest is recomputed for a payload and must equal the header's; a revisit has its header's digest and length. An
    empty manifest gives no rows.
    """

    def setup():
        def one(path, size, start, end):
            system, at = filesystem(path)
            with system.open_input_file(at) as f:
                for offset, record in records(f, size, start, end):
                    head, block = parse(record)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = head["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != stated:
                        raise ValueError(f"{path} at {offset}: the payload's digest differs from its header's")
                    n = len(payload) if kind == "response" else next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    row = (_page(head.get("warc-record-id")), kind, head.get("warc-target-uri"), _page(head.get("warc-refers-to")), n, stated)
                    yield (*row, payload if kind == "response" else None) if with_payload else row

        return one

    ranges = manifest.select("path", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "size", "start", F.least(F.col("start") + split, "size").alias("end"))
    n = manifest.select(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    schema = "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else "")
    return map_rows(ranges.repartition(int(min(n, 10_000))), schema, setup)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; other columns are not read) to archives in the shared folder; gives their manifest."""
    return stage(write_archives(with_revisits(pages), new_path(spark, "warc")), "manifest")
