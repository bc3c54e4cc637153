"""WARC archives through a table of chunks.

Writing: the rows of a page table become records; of pages with the same payload of at
least ``min_revisit`` bytes, the smallest ``page_id`` has the response, the others refer
to it.  A payload is written as HTTP chunks of at most ``chunk_bytes``, cut between
characters, so one line of the text writer is one chunk and no record is put together.
Archives are gzip files, one per task, through Spark's own writer, so that any shared
storage does.

Reading: a gzip file is read by one task, line by line.  ``read_chunks`` turns the lines
into rows (record_id, chunk_no, chunk, ...) and carries the length and the SHA-256 of the
payload so far; the last row of a record has those of the whole payload.  Memory is
bounded by a chunk, however long a record is.

A null html is an empty payload, a null url has no target line.  A null ``page_id`` is
the largest.  Rows with the smallest ``page_id`` of a payload are all responses, if it
occurs again.  Further columns aren't written; an empty table gives archives without records.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm.common import written

CHUNK_BYTES = 65_536
#: Payloads of fewer bytes are always written.
MIN_REVISIT = 100
#: Payloads with at least this fraction of the pages are matched without a shuffle.
HOT = 0.001
#: Bytes of lines or chunks that are handed on at a time.
BATCH_BYTES = 4_000_000
ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The pages with payload_bytes, payload_digest, record_type and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    narrow = rows.where(F.col("payload_bytes") >= min_revisit).select("payload_digest", "page_id")
    total = pages.count()
    repeated = written(narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    # At most 1 / HOT payloads can be so frequent: a bounded broadcast.
    hot = repeated.where(F.col("n") >= HOT * total).drop("n")
    cold = repeated.where(F.col("n") < HOT * total).drop("n")
    small = rows.where(F.col("payload_bytes") < min_revisit).withColumn("first", F.lit(None).cast("long"))  # all null html, too: never joined
    large = rows.where(F.col("payload_bytes") >= min_revisit)
    settled = large.join(F.broadcast(hot), "payload_digest")
    others = large.join(F.broadcast(hot.select("payload_digest")), "payload_digest", "left_anti").join(
        cold, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return settled.unionByName(others).unionByName(small).select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def cut(payload: bytes, size: int):
    """Pieces of at most ``size`` bytes that end between characters."""
    view, at = memoryview(payload), 0
    while at < len(view):
        end = min(at + size, len(view))
        while end < len(view) and view[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        yield view[at:end]
        at = end


def lines(page_id, url, html, size, digest, kind, refers_to, chunk_bytes):
    """The lines of a record without their line feeds; a chunk with what frames it is one line."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        http += b"Content-Length: %d\r\n\r\n" % size
        length = len(http)
    else:
        http += b"Transfer-Encoding: chunked\r\n\r\n"
        length = len(http) + 5 + sum(len(f"{len(c):x}") + 4 + len(c) for c in cut(html, chunk_bytes))
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    yield "\r\n".join([*head, "", ""]).encode() + http[:-1]
    if kind != "revisit":
        for c in cut(html, chunk_bytes):
            yield b"%x\r\n%b\r" % (len(c), c)
        yield b"0\r\n\r"
    yield b"\r\n\r"


def write_archives(recorded: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the records as gzip archives into a folder."""

    def framed(batches):
        for batch in batches:
            out, n = [], 0
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                page_id, url, html, *rest = row
                for line in lines(page_id, url, html.encode(), *rest, chunk_bytes):
                    out.append(line.decode())
                    n += len(line)
                    if n >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, n = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    recorded.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(
        framed, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


class Reader:
    """Takes an archive's lines one by one and makes rows of chunks."""

    def __init__(self, keep: bool):
        self.keep, self.step, self.rows, self.held = keep, self._warc, [], 0
        self.head = None  # while no record has begun

    def _warc(self, line: bytes) -> None:
        line = line.rstrip(b"\r")
        if line.startswith(b"WARC/"):
            self.head, self.http, self.no, self.size, self.sha = {}, {}, 0, 0, hashlib.sha256()
        elif line:
            name, _, value = line.decode().partition(": ")
            self.head[name.lower()] = value
        elif self.head is not None:
            self.step = self._http

    def _http(self, line: bytes) -> None:
        line = line.rstrip(b"\r")
        if line:
            name, _, value = line.decode().partition(": ")
            self.http[name.lower()] = value
        elif self.head["warc-type"] == "revisit":
            self._row(b"", int(self.http["content-length"]), self.head["warc-payload-digest"].removeprefix("sha256:"), True)
            self._end()
        else:
            self.step = self._size

    def _size(self, line: bytes) -> None:
        self.left = int(line, 16)
        if self.left:
            self.left += 2
            self.parts, self.step = [], self._data
        else:
            self._row(b"", self.size, self.sha.hexdigest(), True)
            self._end()

    def _data(self, line: bytes) -> None:
        self.parts.append(line)
        self.left -= len(line) + 1
        if not self.left:
            chunk = b"\n".join(self.parts)[:-1]
            self.sha.update(chunk)
            self.size += len(chunk)
            self._row(chunk, self.size, self.sha.hexdigest(), False)
            self.step = self._size

    def _row(self, chunk: bytes, size: int, digest: str, last: bool) -> None:
        page, refers = (h.removeprefix(f"<{ID}").removesuffix(">") if (h := self.head.get(k)) else None
                        for k in ("warc-record-id", "warc-refers-to"))
        self.rows.append((page, self.head["warc-type"], refers, self.head.get("warc-target-uri"),
                          self.head["warc-payload-digest"].removeprefix("sha256:"), self.no, chunk if self.keep else None,
                          size, digest, last))
        self.held += len(chunk) if self.keep else 0
        self.no += 1

    def _end(self) -> None:
        self.head, self.step = None, self._warc


NAMES = ["record_id", "record_type", "refers_to", "url", "payload_digest", "chunk_no", "chunk", "bytes_so_far",
         "digest_so_far", "last"]
KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]


def read_chunks(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each chunk of each record, and a last row for each record, which has no chunk."""

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    def parsed(batches):
        reader = Reader(payload)
        for batch in batches:
            for line in batch.column(0).cast(pa.binary()):
                reader.step(line.as_py())
                if reader.held >= BATCH_BYTES or len(reader.rows) >= 10_000:
                    yield batch_of(reader.rows)
                    reader.rows, reader.held = [], 0
        if reader.rows:
            yield batch_of(reader.rows)

    return spark.read.option("lineSep", "\n").schema("value string").text(path).mapInArrow(
        parsed, "record_id string, record_type string, refers_to string, url string, payload_digest string, "
                "chunk_no bigint, chunk binary, bytes_so_far bigint, digest_so_far string, last boolean")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, with what its chunks add up to."""
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return read_chunks(spark, path, payload=False).where("last").select(
        number("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
        (F.col("digest_so_far") == F.col("payload_digest")).alias("digest_agrees"))
