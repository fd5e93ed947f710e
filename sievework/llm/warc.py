"""WARC archives: one gzip member per record, written from pages and read back in sequence.

Archives are rows (archive, data) of bounded size, so that Spark's own commit makes a written table whole even if tasks are lost and repeated; write_files makes a `.warc.gz` file of each, and archive_files reads those by Spark's binaryFile source. Of records with equal payloads of at least REVISIT_BYTES the one with the largest page_id is the response and the others revisit it."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, columns
from sievework.sources.corpus import store

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20  # compressed; an archive closes once it has so many
FEED = 1 << 16  # compressed bytes given to zlib at a time
BROADCAST_GROUPS = 250_000  # groups of equal payloads that are broadcast; beyond that ids are joined by digest, and pages by their own id
HEADER_BYTES = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "archive string, position long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """One record as one gzip member; a revisit if `response` names another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {_uri(url)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}"]
    if response is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(response)}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + press.flush()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, payload, response) to (archive, data)."""
    part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{at:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "data"])

    for batch in batches:
        for row in range(batch.num_rows):
            page, url, payload, response = (batch.column(k)[row].as_py() for k in range(4))
            held.append(record(page, url, payload, response))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
                at, held, size = at + 1, [], 0
    if held:
        yield close()


def write_archives(pages: DataFrame, scratch: Scratch, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """pages (page_id, url, html; further columns are ignored, whatever their names) as a written table of archives (archive, data).

    A null html is an empty payload, a null url an empty one. Payloads may be as long as a row can be; a task holds one record and an archive of ARCHIVE_BYTES and one record. Rows that repeat the largest page_id of their payload are all responses. A null page_id counts as smaller than any; equal payloads that only such rows hold are all responses. No rows give no archives."""
    own = columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    groups = own.where(f"size >= {REVISIT_BYTES}").groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").drop("n")
    groups = scratch.save(groups, "groups")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    if groups.count() <= broadcast_groups:
        own = own.join(F.broadcast(groups), ["digest", "size"], "left").withColumn("response", revisits)
    else:  # a digest may be a third of all rows: under it meet ids alone, and payloads are dealt by page
        key = F.xxhash64("page_id", "digest").alias("key")
        ids = own.where(f"size >= {REVISIT_BYTES}").select("page_id", "digest", "size", key).join(groups.hint("merge"), ["digest", "size"]).withColumn("response", revisits)
        ids = scratch.save(ids.where("response is not null").select("key", "digest", F.col("page_id").alias("page"), "response").distinct(), "revisits")
        same = (F.col("own.key") == F.col("ids.key")) & (F.col("own.digest") == F.col("ids.digest")) & F.col("own.page_id").eqNullSafe(F.col("ids.page"))
        own = own.withColumn("key", key).alias("own").join(ids.hint("merge").alias("ids"), same, "left")
    return scratch.save(own.select("page_id", "url", "payload", "response").mapInArrow(_write, "archive string, data binary"), "archives")


class Reader:
    """Reads an archive from the front, never holding more than one record."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.buffer, self.inflate, self.member = data, 0, bytearray(), None, 0

    def _more(self) -> bool:
        """Inflates the next bytes of the current member; false at its end."""
        if self.inflate.eof:
            return False
        piece = self.inflate.unconsumed_tail
        if not piece:
            if self.at >= len(self.data):
                raise ValueError("the archive ends inside a member")
            piece = self.data[self.at : self.at + FEED]
            self.at += len(piece)
        self.buffer += self.inflate.decompress(piece, FEED * 4)
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
        return True

    def _until(self, n: int) -> None:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the member ends inside a record")

    def records(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """Place of the member, header fields in lower case, block."""
        while self.at < len(self.data):
            place, self.buffer, self.inflate = self.at, bytearray(), zlib.decompressobj(31)
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if len(self.buffer) > HEADER_BYTES or not self._more():
                    raise ValueError("no end of a record's header")
            lines = bytes(self.buffer[:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(head["content-length"])
            self._until(end + 4 + n + 4)
            block = bytes(self.buffer[end + 4 : end + 4 + n])
            while self._more():
                pass
            if self.buffer[end + 4 + n :] != b"\r\n\r\n":
                raise ValueError("the record doesn't end at its content length")
            yield place, head, block


def _number(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
    for batch in batches:
        for row in range(batch.num_rows):
            name, data, out, size = batch.column(0)[row].as_py(), memoryview(batch.column(1)[row].as_buffer() or b""), [], 0
            reader = Reader(data)
            try:
                for place, head, block in reader.records():
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    kind, wanted, error = head.get("warc-type"), head.get("warc-payload-digest", ""), None
                    if _digest(block) != head.get("warc-block-digest"):
                        error = "block digest differs"
                    elif kind == "response" and (_digest(payload) != wanted or not length or int(length[1]) != len(payload)):
                        error = "payload digest or length differs"
                    hexed = base64.b32decode(wanted.removeprefix("sha1:")).hex() if wanted else None
                    out.append((name, place, kind, _number(head.get("warc-record-id")), head.get("warc-target-uri"), _number(head.get("warc-refers-to")), int(length[1]) if length else None, hexed, payload if kind == "response" else None, error))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out, size = [], 0
            except (ValueError, KeyError, zlib.error) as broken:  # what was whole before stays; the rest of the archive is one error row
                out.append((name, reader.at, None, None, None, None, None, None, None, str(broken)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of archives (archive, data), with READ's columns. payload is null for revisits, whose payload_bytes are those of the full payload. A record whose digests differ has an error; a broken archive ends with a row that has nothing but archive, position and error. A null or empty archive has no records."""
    return columns(archives, "archive", "data").mapInArrow(_read, READ)


def write_files(archives: DataFrame, root: str, run: str) -> str:
    """Puts archives (archive, data: a written table) into files <root>/<run>/<archive>, and returns that folder. Its name is given once all are written, so a task that is lost and repeated leaves no doubles, and a failed run nothing; a run that is there already isn't written again. Null or empty archives become empty files."""
    return store(archives.select(F.lit("").alias("folder"), F.col("archive").alias("stored_name"), F.col("data").alias("content")), root, run)


def archive_files(spark, path: str) -> DataFrame:
    """Archives (archive, data) from .warc.gz files of at most 2 GB, by Spark's binaryFile source."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))
