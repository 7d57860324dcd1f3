"""Page by page: texts of the pages of files, each page failing for itself, and the first hit of a ladder of attempts.

Pages are cut, tried and read in one stage, so their bytes never leave the task; only texts are put together again, by the
number of the page. A provider is made on the first page that a worker meets, and kept by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

_made: dict[str, object] = {}  # providers of this worker
_HIT = ["page", "attempt", "found", "tries", "error"]


def _provider(name: str, make: Callable[[], Callable]) -> Callable:
    if name not in _made:
        _made[name] = make()
    return _made[name]


def page_texts(files: DataFrame, key: str, pages: Callable[[bytes], Iterable[bytes]], make: Callable[[], Callable[[bytes], str | None]]) -> DataFrame:
    """(key, page, text, error): a row a page of each file (key, content), pages from 0.

    ``pages`` cuts a file, ``make`` makes the provider that reads a page. A page that raises has the kind of its exception for
    an error, and the others are still read; a file that cannot be cut has one row, page -1. Null contents have no pages.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, content in enumerate(batch.column(1)):
                if not content.is_valid:
                    continue
                at = -1
                try:
                    for at, page in enumerate(pages(content.as_py())):
                        try:
                            rows.append((i, at, _provider(name, make)(page), None))
                        except Exception as e:  # noqa: BLE001  a page's failure is the page's
                            rows.append((i, at, None, type(e).__name__))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, -1, None, type(e).__name__))
            index, numbers, texts, errors = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                names=[key, "page", "text", "error"])

    return files.select(key, "content").mapInArrow(run, T.StructType([files.schema[key], *T.StructType.fromDDL("page int, text string, error string")]))


def joined_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, n_pages, n_failed, text): the texts of a file's pages in order, blank ones left out, line by line; null if none has any."""
    order = F.array_sort(F.collect_list(F.struct("page", F.trim("text").alias("text"))))
    grouped = pages.groupBy(key).agg(F.count_if(F.col("page") >= 0).alias("n_pages"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), order.alias("told"))
    said = F.filter(F.transform("told", lambda p: p["text"]), lambda x: x != "")
    return grouped.select(key, "n_pages", "n_failed", F.when(F.size(said) > 0, F.array_join(said, "\n")).alias("text"))


def first_hits(files: DataFrame, key: str, pages: Callable[[bytes], Iterable[bytes]], ladder: list[tuple[str, Callable[[bytes], bytes | None]]],
               make: Callable[[], Callable[[bytes], str | None]]) -> DataFrame:
    """(key, page, attempt, found, tries, error): the first thing that a reader finds in a file, page by page and attempt by attempt.

    ``ladder``: names of attempts and what they make of a page (null: nothing to try). Whatever follows the first hit is neither cut nor
    tried. A try that raises counts as none and the last such error is kept; without a hit page, attempt and found are null.
    """
    name = uuid.uuid4().hex

    def search(content: bytes) -> tuple:
        tries, error = 0, None
        try:
            for at, page in enumerate(pages(content)):
                for attempt, prepare in ladder:
                    try:
                        ready = prepare(page)
                        if ready is None:
                            continue
                        tries += 1
                        if found := _provider(name, make)(ready):
                            return at, attempt, found, tries, None
                    except Exception as e:  # noqa: BLE001
                        error = type(e).__name__
        except Exception as e:  # noqa: BLE001
            error = type(e).__name__
        return None, None, None, tries, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            rows = [search(c.as_py()) if c.is_valid else (None, None, None, 0, None) for c in batch.column(1)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *_HIT])

    return files.select(key, "content").mapInArrow(run, T.StructType([files.schema[key], *T.StructType.fromDDL("page int, attempt string, found string, tries int, error string")]))
