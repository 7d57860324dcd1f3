"""Hard-negative mining by a full sort of each anchor's scores.

Anchors and rows are packed into blocks, each written once. A grid deals groups of anchors against groups of rows: a block
is sent once to every cell of its line, so a cell is a bounded number of scores and no task holds an anchor's whole list.
In a cell, an anchor's scores with a block of rows are sorted by score and id; of the rows of other labels, each
positive's upper limit is found by binary search and the next k entries at or above its lower limit are read. The
best of a cell go on, and windows with a limit merge cells. The positives, whose scores set the limits, come from a
first pass over the same grid.

Scores are exact integers of any size; limits are compared by whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.hamerly import _narrow
from quillspark.llm.storage import discarded, written
from quillspark.llm.topk import _dot, _matrix, down_key, from_down_key, integer_vectors

BLOCK = 512
BLOCK_BYTES = 1 << 20
CELL_ANCHORS, CELL_ROWS = 1 << 14, 1 << 16  # of a cell: at most about 2^30 scores
CELL_BYTES = 64 << 20  # of the rows of a cell
_TOP = (1 << 63) - 1
_PACKED = "block long, width int, kind string, vectors binary, ids array<long>, labels array<string>"
_HIT = "block long, at int, slot int, id long, score long, big binary"
_HIT_ARROW = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("big", pa.binary())])


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks of rows (id, v, label), each sorted by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            step, at = BLOCK, 0
            while at < batch.num_rows:
                part = batch.slice(at, step)
                matrix = _matrix(part.column(1))
                fits = max(1, BLOCK_BYTES // (8 * max(1, matrix.shape[1])))
                if len(matrix) > fits:
                    part, matrix = part.slice(0, fits), matrix[:fits]
                ids = part.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                kind, data = _narrow(matrix[order])
                yield pa.RecordBatch.from_pylist([{
                    "block": block, "width": matrix.shape[1], "kind": kind, "vectors": data, "ids": ids[order].tolist(),
                    "labels": part.column(2).take(pa.array(order)).to_pylist()}], pa.schema([
                        ("block", pa.int64()), ("width", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))]))
                block, at = block + 1, at + len(matrix)

    return rows.select("id", "v", "label").mapInArrow(run, _PACKED)


def _vectors(row: dict, side: str) -> np.ndarray:
    return np.frombuffer(row[f"{side}vectors"], row[f"{side}kind"]).reshape(-1, row[f"{side}width"]).astype(np.float64) if row[f"{side}width"] else np.zeros((len(row[f"{side}ids"]), 0))


class _Lists:
    """The k best (score, id) of each (anchor, slot) of a block of anchors."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: descending, ids ascending in ties; no more than k."""
        if not len(scores):
            return
        now = self.held.get(key, [])
        if len(now) == self.k and (-int(scores[0]), int(ids[0])) >= now[-1]:
            return
        self.held[key] = sorted(now + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)])[: self.k]

    def rows(self, block: int) -> pa.RecordBatch:
        rows = []
        for (at, slot), hits in self.held.items():
            for down, i in hits:
                rows.append({"block": block, "at": at, "slot": slot, "id": i, "score": max(-_TOP - 1, min(_TOP, -down)), "big": down_key(-down) if abs(down) >= _TOP else None})
        return pa.RecordBatch.from_pylist(rows, _HIT_ARROW)


def limits(score: int, low: int, high: int, of: int) -> tuple[int, int]:
    """The least and the greatest whole number s with low * score <= of * s <= high * score."""
    return -(-low * score // of), high * score // of


def positives_of(scores: np.ndarray, row: dict, lists: _Lists) -> None:
    """Adds each anchor's best other rows of its label."""
    labels, ids = np.array(row["labels"], dtype=object), np.array(row["ids"])
    for a, (own, label) in enumerate(zip(row["a_ids"], row["a_labels"], strict=True)):
        mine = np.flatnonzero((labels == label) & (ids != own))
        order = np.argsort(-scores[a, mine], kind="stable")[: lists.k]
        lists.add((a, 0), scores[a, mine[order]], ids[mine[order]])


def negatives_of(scores: np.ndarray, row: dict, lists: _Lists, low: int, high: int, of: int) -> None:
    """Adds, for each positive of each anchor, the best rows of other labels within the positive's limits."""
    labels, ids = np.array(row["labels"], dtype=object), np.array(row["ids"])
    order = np.argsort(-scores, axis=1, kind="stable")  # rows are in the order of ids: this sorts by score, then id
    for a, positives in enumerate(row["a_positives"]):
        if not positives:
            continue
        full = order[a][labels[order[a]] != row["a_labels"][a]]
        down = -scores[a, full]
        for p in positives:
            least, most = limits(from_down_key(p["big"]) if p["big"] else p["score"], low, high, of)
            if least > most:
                continue
            first = int(np.searchsorted(down, -most, side="left")) if abs(most) < _TOP or down.dtype == object else 0 if most > 0 else len(down)
            some = full[first : first + lists.k]
            some = some[[int(s) >= least for s in scores[a, some]]] if len(some) else some
            lists.add((a, p["slot"]), scores[a, some], ids[some])


def _grid(anchors: DataFrame, rows: DataFrame, cells: tuple[int, int], k: int, judge: Callable) -> DataFrame:
    """(block, at, slot, id, score, big): the k best that ``judge`` adds of each cell of the grid."""
    (down, across), own = cells, rows.columns
    n = max(down * across, rows.sparkSession.sparkContext.defaultParallelism)
    line = F.pmod(F.xxhash64("block"), F.lit(down)).cast("int")
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], line.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"))
    b = rows.select(*rows.columns, F.pmod(F.xxhash64("block"), F.lit(across)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"))
    cell = (F.col("i") * across + F.col("j")).alias("cell")
    a = a.select(cell, *[f"a_{c}" for c in anchors.columns]).repartition(n, "cell")
    b = b.select(cell, *rows.columns).repartition(n, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists, mine = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column("a_block")[i].as_py()
                if now != block:
                    if lists:
                        yield lists.rows(block)
                    block, lists = now, _Lists(k)
                    mine = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c.startswith("a_")}
                    mine_vectors = _vectors(mine, "a_")
                row = mine | {c: batch.column(c)[i].as_py() for c in own}
                judge(_dot(mine_vectors, _vectors(row, "")), row, lists)
        if lists:
            yield lists.rows(block)

    return a.join(b.hint("shuffle_hash"), "cell").drop("cell").mapInArrow(run, _HIT)


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """``hits`` with rank, the k best of each anchor and slot; Spark prunes each task's rows before they are sent."""
    best = Window.partitionBy("block", "at", "slot").orderBy(F.col("score").desc(), "big", "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, k: int = 10, low: int = 30, high: int = 90, of: int = 100,
                   scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the table (vec_id, embedding, label).

    Anchors: rows that ``is_anchor`` holds of (a condition on ``id``). A score is the inner product of floor(scale * x),
    exact; a vector shorter than another is padded with zeros. An anchor's positives are its best other rows of the same
    label; for each, the best k rows of other labels with low * positive <= of * negative <= high * positive are returned, by
    score, then id. Rows with a null id, label or vector or a null or non-finite component take no part. Rows of one id,
    label and vector are one anchor; no row with the anchor's id is its positive; other repeated rows count each. A label
    column may be of any type that casts to a string. The score columns stop at the limits of a long; the order does not. Other
    columns take no part; an empty table gives no rows.
    """
    spark = df.sparkSession
    named = df.select("vec_id", "embedding", (F.col(label) if isinstance(label, str) else label).cast("string").alias("label"))
    vectors = integer_vectors(named.where("label is not null"), scale=scale, kept=("label",))
    rows = written(_packed(vectors), "negatives-rows")
    anchors = written(_packed(vectors.where(is_anchor).dropDuplicates(["id", "label", "v"])), "negatives-anchors")

    def groups(table: DataFrame, most: int) -> int:
        blocks, size = table.written_size
        return max(1, math.ceil(max(blocks * BLOCK / most, size / CELL_BYTES)))

    down = groups(anchors, CELL_ANCHORS)
    across = max(groups(rows, CELL_ROWS), min(rows.written_size[0], spark.sparkContext.defaultParallelism))
    best = _merged(_grid(anchors, rows, (down, across), positives, positives_of), positives)
    found = written(best.select("block", "at", F.col("rank").alias("slot"), "id", "score", "big"), "negatives-positives")
    hit = F.struct("at", "slot", "score", "big")
    held = found.groupBy("block").agg(F.collect_list(hit).alias("hits"))  # of a block of anchors: bounded
    each = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.filter("hits", lambda h: h["at"] == i))
    armed = written(anchors.join(held, "block").select(*anchors.columns, each.alias("positives")), "negatives-armed")
    mined = _merged(_grid(armed, rows, (down, across), k, lambda s, row, lists: negatives_of(s, row, lists, low, high, of)), k)
    mined = written(mined, "negatives-found")
    names = anchors.select("block", F.posexplode("ids").alias("at", "anchor_id"))
    pair = found.select("block", "at", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["block", "at"])
    return mined.join(pair, ["block", "at", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
