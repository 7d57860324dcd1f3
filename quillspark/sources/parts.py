"""``document_parts``: the parts of containers and PDFs as rows, read by a data source of its own, batch or stream.

A row is a part: its file, its place, its name and kind, and its text or bytes. Kinds: ``xml`` and ``image`` are entries
of a container, ``entry`` its others, ``stream`` an inflated stream of a PDF, ``broken`` a file that cannot be read or
unpacks to too much, which has this row only. Files are listed once; partitions are planned by the sizes of files, so that a task
reads about ``partitionBytes``. A stream reads the files that are new by time of change and path.

    register_parts(spark)
    spark.read.format("document_parts").load("s3://bucket/inbox")
    spark.readStream.format("document_parts").load("/inbox")
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, ordinal int, part string, kind string, text string, content binary"
PARTITION_BYTES = 128 << 20
MOST_UNPACKED = 512 << 20  # bytes that one file may unpack to
BATCH_BYTES = 8 << 20  # of parts sent to Spark at a time
ROW_BYTES = 512  # of a part besides its text and bytes, while it is an object
_ARROW = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("part", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("content", pa.binary())])
_STREAM_START, _OBJECT = re.compile(rb"(?<!end)stream\r?\n"), re.compile(rb"\d+\s+\d+\s+obj\b")


class TooLarge(ValueError):
    """A file that unpacks to more than may be held."""


def stream_bodies(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, body) of the deflated streams of a PDF. A stream's dictionary is all between its object's head and it."""
    at = 0
    while m := _STREAM_START.search(content, at):
        end = content.find(b"endstream", m.end())
        if end < 0:
            return
        heads = [h.end() for h in _OBJECT.finditer(content, at, m.start())]
        if re.search(rb"/Filter\s*\[?\s*/FlateDecode", content[heads[-1] if heads else at : m.start()]):
            yield m.end(), content[m.end() : end]
        at = end + len(b"endstream")


def inflated(body: bytes, left: int) -> bytes | None:
    """An inflated stream, null if it is damaged. Raises TooLarge beyond ``left`` bytes."""
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(body, left + 1)
    except zlib.error:
        return None
    if len(out) > left:
        raise TooLarge("a stream")
    return out if engine.eof else None


def parts_of(content: bytes) -> Iterator[tuple[str, str, str | None, bytes | None]]:
    """(name, kind, text, bytes) of the parts of a file, in its order; nothing of files that are neither containers nor PDFs."""
    left = MOST_UNPACKED
    if content.startswith(b"PK\x03\x04"):
        with zipfile.ZipFile(io.BytesIO(content)) as box:
            for info in box.infolist():
                if info.is_dir():
                    continue
                left -= info.file_size
                if left < 0:
                    raise TooLarge(info.filename)
                data, ending = box.read(info), info.filename.lower().rpartition(".")[2]
                if ending == "xml":
                    yield info.filename, "xml", data.decode("utf-8", "replace"), None
                else:
                    yield info.filename, "image" if ending in ("png", "jpg", "jpeg") else "entry", None, data
    elif content.startswith(b"%PDF-"):
        for at, body in stream_bodies(content):
            data = inflated(body, left)
            if data is not None:
                left -= len(data)
                yield str(at), "stream", data.decode("latin-1"), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def rows_of(path: str, content: bytes) -> list[pa.RecordBatch]:
    """The rows of a file; one of kind ``broken`` if any of it cannot be read. Until that is known they are held as columns."""
    batches, held, size = [], [], 0
    try:
        for i, part in enumerate(parts_of(content)):
            held.append((path, i, *part))
            size += len(part[2] or "") + len(part[3] or b"") + ROW_BYTES
            if size > BATCH_BYTES:
                batches.append(_batch(held))
                held, size = [], 0
    except Exception as e:  # noqa: BLE001  any damage of a file is the file's, not the job's
        return [_batch([(path, 0, type(e).__name__, "broken", None, None)])]
    return [*batches, _batch(held)] if held else batches


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _listed(uri: str, pattern: str) -> list[tuple[int, str, int]]:
    """(time of change, path, size) of the files under ``uri`` whose names fit, in that order."""
    system, root = _opened(uri)
    infos = system.get_file_info(pafs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == pafs.FileType.Directory else [system.get_file_info(root)]
    files = [f for f in infos if f.type == pafs.FileType.File and re.fullmatch(pattern, f.base_name) and not f.base_name.startswith(("_", "."))]
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in files)


def planned(files: list[tuple[str, int]], most: int, least: int = 1) -> list[list[str]]:
    """Files dealt to partitions, large ones first, each to the emptiest, so that none holds much more than ``most`` bytes."""
    import heapq

    n = min(len(files), max(least, -(-sum(size for _, size in files) // most)))
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        held, i = heapq.heappop(heap)
        out[i].append(path)
        heapq.heappush(heap, (held + size + 4096, i))  # opening a file costs as much as some bytes
    return [sorted(x) for x in out]


def _read(options: dict, partition: _Files | None) -> Iterator[pa.RecordBatch]:
    if partition is None:  # Spark's only partition where none is planned
        return
    system, _ = _opened(options["path"])
    for path in partition.files:
        with system.open_input_file(path) as f:
            content = f.read()
        yield from rows_of(path, content)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        files = [(path, size) for _, path, size in _listed(self.options["path"], self.options.get("pattern", ".*"))]
        return [_Files(x) for x in planned(files, int(self.options.get("partitionbytes", PARTITION_BYTES)), int(self.options.get("leastpartitions", 1)))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the last (time of change, path) read; files that appear later with an earlier time are not read."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.options["path"], self.options.get("pattern", ".*"))
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (start["time"], start["path"]), (end["time"], end["path"])
        files = [(path, size) for time, path, size in _listed(self.options["path"], self.options.get("pattern", ".*")) if first < (time, path) <= last]
        return [_Files(x) for x in planned(files, int(self.options.get("partitionbytes", PARTITION_BYTES)))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class DocumentParts(DataSource):
    """Options: path (``load``'s), pattern (of file names, a regular expression), partitionBytes, leastPartitions."""

    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader({k.lower(): v for k, v in self.options.items()})


def register_parts(spark: SparkSession) -> None:
    """Makes ``document_parts`` known to the session."""
    spark.dataSource.register(DocumentParts)
