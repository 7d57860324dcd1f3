"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers, floor(scale * x). Neighbours in a locality order form blocks of up to ``BLOCK`` documents, written
once: a block's row is its forward index (ids and vectors) with the largest and the smallest value of each term. The sum over
terms of the larger of query times largest and query times smallest bounds every score in the block.

Queries come in chunks of about ``QUERY_BYTES``. For a chunk, the table of maxima gives each query the ``FIRST`` blocks of the
highest bounds in the whole index; these are scored, and their kth score is the query's threshold everywhere. Then every
task takes its blocks in the order of their bounds, query by query, and scores those whose bound is not below the kth score
so far, at least the threshold; an equal bound is still visited, since ties go to the smaller id. So the index is read twice
a chunk and never shuffled, and what tasks return is about k rows a query in all.

Scores are exact: by floating point where every sum stays exact in it, by 64-bit integers, or by Python's integers.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.storage import discarded, shared_dir, written

BLOCK = 256
BLOCK_BYTES = 1 << 20  # a block of long vectors holds fewer
GROUP_BLOCKS = 64  # blocks that a task scores side by side
PIVOTS = 64
FIRST = 4
QUERY_BYTES = 16 << 20
_EXACT, _WIDE = 1 << 52, 1 << 62
_LOWEST = np.iinfo(np.int64).min
_NONE = -(1 << 5000)  # below every score
_FOUND = "query long, query_id long, vec_id long, score long, big binary"


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024, null_ids: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, v, and the columns ``kept``) with v = floor(scale * x), whole numbers held as doubles.

    Rows with a null id (unless ``null_ids``), a null vector or a null or non-finite component go; all others stay, whatever their size. An
    error is raised where scale * x leaves the range of doubles.
    """
    x = F.transform(F.col(f"`{embedding}`"), lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def scaled(e):
        y = e * float(scale)
        whole = F.when(F.abs(y) < float(_EXACT), F.floor(y).cast("double")).otherwise(y)
        return F.when(F.abs(y) < float("inf"), whole).otherwise(F.raise_error(F.lit("a component leaves the range of doubles")).cast("double"))

    return df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), x.alias("x"), *kept).where(
        (F.lit(null_ids) | F.col("id").isNotNull()) & F.col("x").isNotNull() & fine
    ).select("id", F.transform("x", scaled).alias("v"), *kept)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


_integers = np.frompyfunc(int, 1, 1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: int64, or Python integers where these might not do."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if reach < _EXACT:
        return (a @ b.T).astype(np.int64)
    if reach < _WIDE and np.abs(a).max(initial=0) < _WIDE and np.abs(b).max(initial=0) < _WIDE:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return np.dot(_integers(a), _integers(b.T)) if width else np.zeros((len(a), len(b)), dtype=np.int64)


def _bounds(q: np.ndarray, largest: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """Upper bounds of queries' scores in blocks, in floating point with a margin above its rounding; nan bounds nothing."""
    width = min(q.shape[1], largest.shape[1])
    q, largest, smallest = q[:, :width], largest[:, :width], smallest[:, :width]
    with np.errstate(all="ignore"):
        most = np.maximum(q, 0) @ largest.T + np.minimum(q, 0) @ smallest.T
        return most + np.abs(q) @ np.maximum(np.abs(largest), np.abs(smallest)).T * 1e-12


def _below(x: int) -> float:
    """A float at most ``x``."""
    if abs(x) < _EXACT:
        return float(x)
    try:
        return math.nextafter(float(x), -math.inf)
    except OverflowError:
        return sys.float_info.max if x > 0 else -math.inf


class _Best:
    """The k best of each query so far: scores descending, ids ascending. floor: scores below it need not be kept."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), _LOWEST)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros(n, dtype=np.int64)
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.k, self.least = k, self.floor.copy()  # least: a lower bound of the kth score

    def _widen(self) -> None:
        if self.score.dtype != object:
            self.score = self.score.astype(object)
            self.score[np.arange(self.k)[None, :] >= self.full[:, None]] = _NONE

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """rows: the queries; scores: of queries by candidates; own: where a candidate is the query itself."""
        if scores.dtype == object:
            self._widen()
        wide = self.score.dtype == object
        useful = ~own & ((scores >= self.score[rows, -1][:, None]) | (self.full[rows] < self.k)[:, None])
        some = useful.any(axis=1)
        if not some.any():
            return
        rows, scores, useful = rows[some], scores[some].astype(self.score.dtype), useful[some]
        all_scores = np.concatenate([self.score[rows], np.where(useful, scores, _NONE if wide else _LOWEST)], axis=1)
        all_ids = np.concatenate([self.id[rows], np.where(useful, ids[None, :], np.iinfo(np.int64).max)], axis=1)
        if wide:
            order = np.array([sorted(range(len(s)), key=lambda i: (-s[i], x[i]))[: self.k] for s, x in zip(all_scores, all_ids, strict=True)])
        else:
            order = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.id[rows] = np.take_along_axis(all_ids, order, axis=1)
        self.full[rows] = np.minimum(self.k, self.full[rows] + useful.sum(axis=1))
        for r in rows[self.full[rows] >= self.k]:
            self.least[r] = max(self.floor[r], _below(int(self.score[r, -1])))

    def found(self, numbers: np.ndarray, query_ids: np.ndarray) -> pa.RecordBatch:
        """The rows found, without those below the floor."""
        query, place = np.nonzero(np.arange(self.k)[None, :] < self.full[:, None])
        scores = [int(s) for s in self.score[query, place]]
        keep = np.array([_below(s) >= f or s >= f for s, f in zip(scores, self.floor[query], strict=True)], dtype=bool)
        query, place, scores = query[keep], place[keep], [s for s, x in zip(scores, keep, strict=True) if x]
        top = (1 << 63) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers[query]), pa.array(query_ids[query]), pa.array(self.id[query, place].astype(np.int64)),
             pa.array([max(-top - 1, min(top, s)) for s in scores], pa.int64()), pa.array([down_key(s) if abs(s) >= top else None for s in scores], pa.binary())],
            names=["query", "query_id", "vec_id", "score", "big"])


def down_key(n: int) -> bytes:
    """Bytes that sort as -n does."""
    body = abs(n).to_bytes((abs(n).bit_length() + 7) // 8 or 1)
    key = len(body).to_bytes(4) + body
    return b"\x01" + key if n <= 0 else b"\x00" + bytes(255 - x for x in key)


def from_down_key(key: bytes) -> int:
    """The number of a ``down_key``."""
    body = key[1:] if key[0] else bytes(255 - x for x in key[1:])
    n = int.from_bytes(body[4:])
    return -n if key[0] else n


def search_blocks(queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], largest: np.ndarray, smallest: np.ndarray,
                  best: _Best, wanted: np.ndarray | None = None) -> int:
    """Scores blocks (ids, vectors) against all queries into ``best``; returns the number of (query, block) pairs scored.

    wanted: of queries by blocks, where a pair is to be looked at.
    """
    bound = _bounds(queries, largest, smallest)
    if wanted is not None:
        bound[~wanted] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable")
    active, scored = np.arange(len(queries)), 0
    for step in range(len(blocks)):
        block = order[active, step]
        keep = ~(bound[active, block] < best.least[active]) if wanted is None else wanted[active, block]
        active, block = active[keep], block[keep]
        if not len(active):
            break
        scored += len(active)
        by_block = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[by_block], prepend=-1))
        for part in np.split(by_block, edges[1:]):
            rows, (ids, vectors) = active[part], blocks[block[part[0]]]
            best.add(rows, _dot(queries[rows], vectors), ids, query_ids[rows][:, None] == ids[None, :])
    return scored


def _packed(ids: list[np.ndarray], parts: list[np.ndarray], block: int) -> tuple:
    width = max(p.shape[1] for p in parts)
    values = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
    return block, np.concatenate(ids).tobytes(), width, values.tobytes(), values.max(axis=0).tobytes(), values.min(axis=0).tobytes()


_BLOCKS = "block long, ids binary, width int, vectors binary, largest binary, smallest binary"


def block_table(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors (id, v) in a locality order, so that they are tight: by the nearest of ``PIVOTS`` sampled vectors, then by a hash."""
    pivots = [r["v"] for r in vectors.orderBy(F.xxhash64("id", "v")).limit(PIVOTS).collect()]
    width = max(map(len, pivots), default=0)
    table = np.zeros((len(pivots), width))
    for i, p in enumerate(pivots):
        table[i, : len(p)] = p
    with np.errstate(all="ignore"):
        table = np.nan_to_num(table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1))
            w = min(width, rows.shape[1])
            with np.errstate(all="ignore"):
                place = np.argmax(rows[:, :w] @ table[:, :w].T, axis=1) if len(pivots) else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], names=["id", "v", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, parts, rows = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in _packed(ids, parts, block)], schema=pa.schema(
                [("block", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary()), ("largest", pa.binary()), ("smallest", pa.binary())]))

        for batch in batches:
            numbers, matrix, at = batch.column(0).to_numpy(), _matrix(batch.column(1)), 0
            step = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, matrix.shape[1]))))
            while at < len(numbers):
                take = min(step - rows if step > rows else 1, len(numbers) - at)
                ids.append(numbers[at : at + take])
                parts.append(matrix[at : at + take])
                at, rows = at + take, rows + take
                if rows >= step:
                    yield flush()
                    block, ids, parts, rows = block + 1, [], [], 0
        if rows:
            yield flush()

    placed = vectors.mapInArrow(nearest, "id long, v array<double>, place int")
    n = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    dealt = placed.repartitionByRange(n, "place", F.xxhash64("id")).sortWithinPartitions("place", "id")
    return dealt.select("id", "v").mapInArrow(pack, _BLOCKS)


@contextmanager
def _groups(spark) -> Iterator[None]:
    """Arrow batches of ``GROUP_BLOCKS`` rows: a block's row is up to a MB long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(GROUP_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _unpacked(batch: pa.RecordBatch, numbers: bool) -> tuple[list, np.ndarray, np.ndarray, list]:
    """(block numbers, largest, smallest, [(ids, vectors)]); maxima are padded with zeros to the longest."""
    columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
    width = max(columns["width"], default=0)
    ends = [np.zeros((len(batch), width)) for _ in range(2)]
    for out, name in zip(ends, ("largest", "smallest"), strict=True):
        for i, x in enumerate(columns[name]):
            out[i, : len(x) // 8] = np.frombuffer(x)
    blocks = []
    if numbers:
        for ids, w, values in zip(columns["ids"], columns["width"], columns["vectors"], strict=True):
            ids = np.frombuffer(ids, dtype=np.int64)
            blocks.append((ids, np.frombuffer(values).reshape(len(ids), w)))
    return columns["block"], *ends, blocks


def _highest(maxima: DataFrame, sent) -> dict[int, list[int]]:
    """block -> the queries that it is among the ``FIRST`` of, by bound, in the whole index. At most ``FIRST`` a query come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value[0]
        bound, block = np.full((len(queries), 0), -np.inf), np.zeros((len(queries), 0), dtype=np.int64)
        for batch in batches:
            names, largest, smallest, _ = _unpacked(batch, False)
            bound = np.concatenate([bound, np.nan_to_num(_bounds(queries, largest, smallest), nan=np.inf)], axis=1)
            block = np.concatenate([block, np.broadcast_to(np.array(names), (len(queries), len(names)))], axis=1)
            order = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
            bound, block = np.take_along_axis(bound, order, axis=1), np.take_along_axis(block, order, axis=1)
        query = np.repeat(np.arange(len(queries)), bound.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(bound.ravel()), pa.array(block.ravel())], names=["query", "bound", "block"])

    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("bound")).alias("down"), "block"))), 1, FIRST)["block"]
    out: dict[int, list[int]] = {}
    for query, blocks in maxima.mapInArrow(run, "query long, bound double, block long").groupBy("query").agg(best).collect():
        for b in blocks:
            out.setdefault(b, []).append(query)
    return out


def _scored(blocks: DataFrame, sent, k: int, first: int) -> DataFrame:
    """The k best of each query in each task. sent: queries, ids, floor of each, and the blocks to look at or None for all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids, floor, picked = sent.value
        best = _Best(len(query_ids), k, floor)
        for batch in batches:
            names, largest, smallest, held = _unpacked(batch, True)
            wanted = None
            if picked is not None:
                wanted = np.zeros((len(queries), len(names)), dtype=bool)
                for i, name in enumerate(names):
                    wanted[picked.get(name, []), i] = True
            search_blocks(queries, query_ids, held, largest, smallest, best, wanted)
        yield best.found(np.arange(first, first + len(query_ids)), query_ids)

    return blocks.mapInArrow(run, _FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query, query_id, best): the k best of each query, by score, then id."""
    hit = F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "big", "vec_id", "score")
    return found.groupBy("query", "query_id").agg(F.slice(F.array_sort(F.collect_list(hit)), 1, k).alias("best"))


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that ``is_query`` holds of, its k best others.

    ``vectors``: of ``integer_vectors``. Fewer than k others: all of them. Ties go to the smaller id. Rows of one id and one
    vector are one query; no row with the query's id is its candidate; other repeated rows are candidates each. Vectors of
    unlike length are padded with zeros. Scores are ordered exactly; the score column stops at the limits of a long. Other
    columns of the table take no part.
    """
    spark = vectors.sparkSession
    blocks = written(block_table(vectors.select("id", "v")), "topk-blocks")
    maxima = written(blocks.select("block", "width", "largest", "smallest"), "topk-maxima")
    queries = written(vectors.where(is_query).select("id", "v").dropDuplicates(["id", "v"]), "topk-queries")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    most = max(1, QUERY_BYTES // (8 * max(1, width, 2 * k)))
    chunks = math.ceil(n / most * 1.3) if n > most else 1
    folder, first = f"{shared_dir(spark)}/quillspark/topk-found-{uuid.uuid4().hex}", 0
    with _groups(spark):
        for chunk in range(chunks):
            rows = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(chunks)) == chunk).orderBy("id").collect()
            for at in range(0, len(rows), most):
                _answer(blocks, maxima, rows[at : at + most], k, first, folder)
                first += len(rows[at : at + most])
    discarded(blocks, maxima, queries)
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema(_FOUND).parquet(folder)
    return _merged(found, k).select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")


def _answer(blocks: DataFrame, maxima: DataFrame, rows: list, k: int, first: int, folder: str) -> None:
    """Adds the answers of a chunk of queries, numbered from ``first``, to the table in ``folder``."""
    context = blocks.sparkSession.sparkContext
    table = np.zeros((len(rows), max(len(r["v"]) for r in rows)))
    for i, r in enumerate(rows):
        table[i, : len(r["v"])] = r["v"]
    ids, floor = np.array([r["id"] for r in rows]), np.full(len(rows), -np.inf)
    sent = context.broadcast((table, ids))
    picked = _highest(maxima, sent)
    sent.unpersist()
    sent = context.broadcast((table, ids, floor, picked))
    some = blocks.join(F.broadcast(blocks.sparkSession.createDataFrame([(b,) for b in picked], "block long")), "block", "left_semi")
    last = F.when(F.size("best") == k, F.element_at("best", -1)["score"])
    for query, score in _merged(_scored(some, sent, k, 0), k).select("query", last).collect():
        if score is not None:  # a score at the end of long may stand for a higher one
            floor[query] = _below(score)
    sent.unpersist()
    sent = context.broadcast((table, ids, floor, None))
    _scored(blocks, sent, k, first).write.mode("append").parquet(folder)
    sent.unpersist()
