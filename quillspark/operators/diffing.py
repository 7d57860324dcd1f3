"""Structural differences of expected and actual records: by path, with the elements of arrays aligned first.

Arrays are aligned by a longest common subsequence of equal elements, so one missing item is one difference and the items
behind it are none. Between aligned elements, those left over are paired in order and compared field by field; what has no partner
is missing or extra as a whole. Records meet by one join; a row is compared by the task that holds it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T


def _said(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True, default=str)


def aligned(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Pairs of places of ``a`` and ``b`` in order: equal ones along a longest common subsequence, else (place, None) or (None, place)."""
    x, y = [_said(v) for v in a], [_said(v) for v in b]
    first = 0
    while first < min(len(x), len(y)) and x[first] == y[first]:
        first += 1
    last = 0
    while last < min(len(x), len(y)) - first and x[-1 - last] == y[-1 - last]:
        last += 1
    p, q = x[first : len(x) - last], y[first : len(y) - last]
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if p[i] == q[j] else max(best[i + 1][j], best[i][j + 1])
    pairs: list[tuple[int | None, int | None]] = [(i, i) for i in range(first)]
    i = j = 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and p[i] == q[j]:
            pairs.append((first + i, first + j))
            i, j = i + 1, j + 1
        elif j == len(q) or i < len(p) and best[i + 1][j] >= best[i][j + 1]:
            pairs.append((first + i, None))
            i += 1
        else:
            pairs.append((None, first + j))
            j += 1
    return pairs + [(len(x) - n, len(y) - n) for n in range(last, 0, -1)]


def compared(path: str, a, b) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(path, kind, expected, actual) of each difference; kinds: changed, missing, extra."""
    a, b = (dict(x) if isinstance(x, list) and x and all(isinstance(y, tuple) for y in x) else x for x in (a, b))  # maps come as pairs
    if isinstance(a, dict) and isinstance(b, dict):
        for name in [*a, *(n for n in b if n not in a)]:
            yield from compared(f"{path}.{name}" if path else name, a.get(name), b.get(name))
    elif isinstance(a, list) and isinstance(b, list):
        left, right = [], []

        def gap() -> Iterator[tuple[str, str, str | None, str | None]]:
            for i, j in zip(left, right, strict=False):
                yield from compared(f"{path}[{i}]", a[i], b[j])
            for i in left[len(right) :]:
                yield f"{path}[{i}]", "missing", _said(a[i]), None
            for j in right[len(left) :]:
                yield f"{path}[{j}]", "extra", None, _said(b[j])
            left.clear()
            right.clear()

        for i, j in aligned(a, b):
            if i is not None and j is not None:
                yield from gap()
            elif i is not None:
                left.append(i)
            else:
                right.append(j)
        yield from gap()
    elif _said(a) != _said(b):
        yield path, "missing" if b is None else "extra" if a is None else "changed", _said(a), _said(b)


def differences(expected: DataFrame, actual: DataFrame, key: str, column: str = "data") -> DataFrame:
    """(key, path, kind, expected, actual): a row a difference between the records of ``column``, of any schema; equal ones give none.

    A record on one side only is one difference, of an empty path. Null keys meet each other. Paths number the expected
    side's elements, or the actual side's where they are extra. Cost grows with the product of the unequal middles of two arrays.
    """
    a, b = expected.select(key, F.col(column).alias("a")).alias("e"), actual.select(F.col(key).alias("key_b"), F.col(column).alias("b"), F.lit(True).alias("there")).alias("f")
    both = a.withColumn("here", F.lit(True)).join(b, F.col(key).eqNullSafe(F.col("key_b")), "full")
    both = both.select(F.when(F.col("here"), F.col(key)).otherwise(F.col("key_b")).alias(key), "a", "b", F.coalesce("here", F.lit(False)).alias("here"), F.coalesce("there", F.lit(False)).alias("there"))
    both = both.where(~(F.col("here") & F.col("there")) | ~F.to_json(F.struct(F.col("a").alias("x"))).eqNullSafe(F.to_json(F.struct(F.col("b").alias("x")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (x, y, here, there) in enumerate(zip(*[batch.column(n).to_pylist() for n in range(1, 5)], strict=True)):
                told = list(compared("", x, y)) if here and there else [("", "missing" if here else "extra", _said(x), _said(y))]
                rows += [i] * len(told)
                found += told
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.string()) for c in columns]], names=[key, "path", "kind", "expected", "actual"])

    return both.mapInArrow(run, T.StructType([expected.schema[key], *T.StructType.fromDDL("path string, kind string, expected string, actual string")]))
