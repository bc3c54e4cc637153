"""Text log files that grow, as a stream.

    spark.dataSource.register(TextLogTail)
    spark.readStream.format("text_log_tail").option("path", "/logs/*.log").load()

The offset of the stream is, for every file, how many of its bytes have been read.  A batch
hands out the records that close in the bytes since the last one: a record closes with the end of the line that
starts the next record, so that the record which is open at the end of a file waits there until it is whole, in no
state but the file itself.  A task looks back from its first byte to the start of the record that is open there.

A file's bytes are dealt out in chunks, so that a file of any size, also one that is new, is read by many tasks and a
task holds no more than a record and a block.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sluicework.sources.logs import ISO_8601

#: Bytes of a file that a task reads at most, and bytes that are read at a time.
CHUNK_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20
#: Bytes from the start of a record within which its last line starts; lines after that are records of their own.
RECORD_BYTES = 16 << 20
#: Seconds after which a file that hasn't grown is taken to be closed.
IDLE = 3600.0
#: Records handed on together.
ROWS = 1_000


@dataclass
class Chunk(InputPartition):
    """Bytes of a file in which records close; ``since`` is where a record that is open there can have begun at the earliest."""

    path: str
    since: int
    begin: int
    end: int
    last: bool  # the file is closed: what is open at the end is handed out


def _lines(file, begin: int, end: int) -> Iterator[tuple[int, bytes, bool]]:
    """The lines from ``begin``, which is where a line begins: (place, line, whether it ended before ``end``)."""
    at, rest = begin, b""
    file.seek(begin)
    while at + len(rest) < end:
        block = file.read(min(BLOCK_BYTES, end - at - len(rest)))
        if not block:
            break
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield at, line, True
            at += len(line) + 1
    if rest:
        yield at, rest, False


def _line_begin(file, at: int, since: int) -> int:
    """Where the line begins that has the byte before ``at``, or that begins at ``at``."""
    while at > since:
        low = max(since, at - BLOCK_BYTES)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return since


def _look_back(file, at: int, since: int, starts) -> int:
    """Where to begin to read, so that the record that is open at ``at`` is known: the last start before, if one is near enough."""
    line = _line_begin(file, at, since)
    least = max(since, _line_begin(file, max(line - 1, since), since) - RECORD_BYTES)  # the line before may be a record's last
    size = max(BLOCK_BYTES >> 4, 1)
    while True:
        low = _line_begin(file, max(least, line - size), since)
        found = [place for place, text, _ in _lines(file, low, line) if starts(text)]
        if found:
            return found[-1]
        if line - size <= least:
            return line
        size *= 4


def records(file, chunk: Chunk, record_start: str) -> Iterator[str]:
    """The records that close in a chunk."""
    start = re.compile(rf"\A(?:{record_start})")

    def text_of(line: bytes) -> str:
        return line.removesuffix(b"\r").decode("utf-8", "replace")

    def starts(line: bytes) -> bool:
        return start.match(text_of(line)) is not None

    held: list[str] = []
    began = -1
    for place, line, whole in _lines(file, _look_back(file, chunk.begin, chunk.since, starts), chunk.end):
        if not whole and not chunk.last:
            break  # the line may go on
        closes = place + len(line) + 1 > chunk.begin  # its end lies in the chunk
        text = text_of(line)
        new = start.match(text) is not None
        if not new and held and place - began <= RECORD_BYTES:
            held.append(text)
            continue
        if held and closes:
            yield "\n".join(held)
        held = []
        if new:
            held, began = [text], place
        elif closes:
            yield text
    if held and chunk.last:
        yield "\n".join(held)


class TailReader(DataSourceStreamReader):
    """Offsets ``{"files": {path: [bytes, closed]}}``."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("text_log_tail needs a path")
        self.where = options["path"]
        self.start = options.get("recordstart", ISO_8601)
        self.idle = float(options.get("idleseconds", IDLE))
        self.chunk = int(options.get("chunkbytes", CHUNK_BYTES))

    def _files(self) -> dict[str, fs.FileInfo]:
        """The files that the path names: a file, a folder, or a folder with a pattern for names in it."""
        folder, _, name = self.where.rpartition("/")
        pattern = None
        if not re.search(r"[*?\[]", name):
            folder, name = self.where, ""
        else:
            pattern = re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in name))
        system, place = fs.FileSystem.from_uri(folder)
        prefix = folder[:len(folder) - len(place)] if folder.endswith(place) else ""
        found = system.get_file_info(place)
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, allow_not_found=True))
        return {prefix + i.path: i for i in infos if i.type == fs.FileType.File and (
            pattern.fullmatch(i.base_name) if pattern else not i.base_name.startswith((".", "_")))}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        now = time.time()
        return {"files": {path: [i.size, i.mtime is None or now - i.mtime.timestamp() >= self.idle] for path, i in sorted(self._files().items())}}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        chunks = []
        for path, (size, closed) in end["files"].items():
            read, was_closed = start["files"].get(path, [0, False])
            if size < read:  # another file of this name
                read, was_closed = 0, False
            if size == read and closed == was_closed:
                continue
            since = read if was_closed else 0
            cuts = [*range(read, size, self.chunk), size] if size > read else [read, size]
            chunks += [Chunk(path, since, a, b, closed and b == size) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return chunks

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(partition.path)
        named = partition.path if ":" in partition.path.split("/")[0] else f"file://{partition.path}"
        with system.open_input_file(place) as file:
            out: list[str] = []
            for record in records(file, partition, self.start):
                out.append(record)
                if len(out) == ROWS:
                    yield pa.RecordBatch.from_pydict({"RawData": out, "FilePath": [named] * len(out)})
                    out = []
            if out:
                yield pa.RecordBatch.from_pydict({"RawData": out, "FilePath": [named] * len(out)})

    def commit(self, end: dict) -> None:
        pass


class TextLogTail(DataSource):
    """Records ``RawData, FilePath`` of growing log files, each once.

    Options: ``path``, a file, a folder or a pattern of names in a folder; ``recordStart``, a regular expression;
    ``idleSeconds``, after which a file that hasn't grown is taken to be closed, so that its last record is handed out (what
    is added later starts anew); ``chunkBytes``.  A file that becomes shorter is read from its start.  A record whose lines
    go on for more than ``RECORD_BYTES`` ends there, and lines that no start precedes so near are records of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "text_log_tail"

    def schema(self) -> str:
        return "RawData string, FilePath string"

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def text_log_tail(spark, path: str, record_start: str = ISO_8601, idle_seconds: float = IDLE):
    """The stream of a path's records."""
    spark.dataSource.register(TextLogTail)
    return spark.readStream.format("text_log_tail").option("path", path).option(
        "recordStart", record_start).option("idleSeconds", idle_seconds).load()
