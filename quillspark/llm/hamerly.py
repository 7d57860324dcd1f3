"""Exact k-means over whole numbers with Hamerly's bounds.

Vectors are written once, in blocks, as a table bucketed by block. Each round writes a table of bounds with the same
buckets: per vector its centroid, an upper bound of the distance to it and one lower bound of the distance to every
other. The next round joins both tables bucket by bucket, without a shuffle, and loosens the bounds by what the centroids
drifted. Only a vector whose bounds then overlap has its upper bound taken anew, and only where that does not help it is
compared with all centroids. Comparisons are of exact integers; bounds are floats with a margin above their rounding, so a
vector is passed over only if its centroid is nearer than all others, ties included.

Sums of clusters follow the vectors that moved: a task adds up what left and what came, and the driver gets at most a few
numbers a centroid and component, already summed. Values of any size are summed exactly, by digits of 32 bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from quillspark.llm.storage import dropped, shared_dir, written
from quillspark.llm.topk import _matrix, integer_vectors

BLOCK_BYTES = 1 << 20  # a block's vectors as doubles
BUCKET_BYTES = 128 << 20
MOST_BUCKETS = 100_000
MARGIN = 1e-12
_EXACT, _WIDE, _TOP = 1 << 52, 1 << 62, (1 << 63) - 1
_DIGIT = 32
_BOUNDS = "block long, cluster binary, upper binary, lower binary, scanned long, moved array<struct<center:int,at:int,digit:int,value:long>>"
_integers = np.frompyfunc(int, 1, 1)


def distances(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers (doubles) to ``centers`` (Python integers): int64, or Python's where that is too small."""
    if not vectors.size or not centers.size:
        return np.zeros((len(vectors), len(centers)), dtype=np.int64)
    farthest = max(abs(x) for x in centers.ravel())
    reach = (int(np.abs(vectors).max()) + farthest) ** 2 * vectors.shape[1]
    if reach < _WIDE:
        kind = np.float64 if reach < _EXACT else np.int64
        v, c = vectors.astype(kind), centers.astype(kind)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(vectors), len(centers)), dtype=object)
    for i, row in enumerate(_integers(vectors)):
        apart = centers - row[None, :]
        out[i] = (apart * apart).sum(axis=1)
    return out


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots, infinite beyond the range of doubles."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.inf if (r := math.isqrt(int(s))) > 1 << 1000 else float(r) if r > _EXACT else math.sqrt(s) for s in squares.ravel()]).reshape(squares.shape)


class Centers:
    """Centroids of a round, with their drift since the last one and half the distance to the nearest other."""

    def __init__(self, rows: list[list[int]], before: Centers | None = None):
        self.rows = np.array(rows, dtype=object).reshape(len(rows), -1)
        n = len(rows)
        whole = [self._apart(i, j) for i in range(n) for j in range(n)]
        between = np.array(whole).reshape(n, n)
        np.fill_diagonal(between, math.inf)
        self.half = between.min(axis=1, initial=math.inf) * 0.5 * (1 - MARGIN)
        self.drift = np.zeros(n)
        if before is not None:
            self.drift = np.array([self._length(a - b) for a, b in zip(self.rows, before.rows, strict=True)]) * (1 + MARGIN)
        order = np.argsort(-self.drift)
        self.farthest = np.full(n, self.drift[order[0]] if n else 0.0)  # the largest drift of the others
        if n:
            self.farthest[order[0]] = self.drift[order[1]] if n > 1 else 0.0

    @staticmethod
    def _length(apart: np.ndarray) -> float:
        return float(_root(np.array([sum(int(x) * int(x) for x in apart)], dtype=object))[0])

    def _apart(self, i: int, j: int) -> float:
        return self._length(self.rows[i] - self.rows[j])


def settle(vectors: np.ndarray, centers: Centers, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple:
    """(cluster, upper, lower, number of vectors compared with all centroids) after ``centers`` drifted; without bounds all are compared."""
    n = len(vectors)
    if cluster is None:
        cluster, upper, lower, open_ = np.zeros(n, dtype=np.int32), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        cluster, p, q = cluster.copy(), centers.drift[cluster], centers.farthest[cluster]
        with np.errstate(invalid="ignore"):  # infinite bounds decide nothing
            upper = (upper + p) * (1 + MARGIN)
            lower = lower - q - MARGIN * (np.abs(lower) + q)
            open_ = np.flatnonzero(~(upper < np.maximum(lower, centers.half[cluster])))
        for c in np.unique(cluster[open_]):  # the upper bound anew
            mine = open_[cluster[open_] == c]
            upper[mine] = _root(distances(vectors[mine], centers.rows[c : c + 1])[:, 0]) * (1 + MARGIN)
        with np.errstate(invalid="ignore"):
            open_ = open_[~(upper[open_] < np.maximum(lower[open_], centers.half[cluster[open_]]))]
    if len(open_):
        d = distances(vectors[open_], centers.rows)
        nearest = d.argmin(axis=1).astype(np.int32)  # the first of equals
        cluster[open_] = nearest
        upper[open_] = _root(d[np.arange(len(d)), nearest]) * (1 + MARGIN)
        if d.shape[1] > 1:
            rest = d.astype(object) if d.dtype == object else d.copy()
            rest[np.arange(len(d)), nearest] = max(int(d.max()), _TOP) if d.dtype == object else _TOP
            second = _root(rest.min(axis=1)) * (1 - MARGIN)
        else:
            second = np.full(len(d), math.inf)
        lower[open_] = np.where(np.isfinite(second) | (d.shape[1] == 1), second, 0.0)
    return cluster, upper, lower, len(open_)


class _Moves:
    """What clusters gained and lost: exact sums of components, and of members at component -1."""

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}

    def add(self, vectors: np.ndarray, cluster: np.ndarray, sign: int) -> None:
        if not len(vectors):
            return
        small = int(np.abs(vectors).max(initial=0)) * len(vectors) < _EXACT
        for c in np.unique(cluster):
            mine = vectors[cluster == c]
            total = mine.sum(axis=0).astype(np.int64).astype(object) if small else _integers(mine).sum(axis=0)
            total = np.append(total, len(mine)) * sign
            self.sums[int(c)] = self.sums.get(int(c), 0) + total

    def rows(self) -> list[dict]:
        out = []
        for c, total in self.sums.items():
            for at, value in enumerate(total):
                at, value, digit = (-1 if at == len(total) - 1 else at), int(value), 0
                while value not in (0, -1):
                    out.append({"center": c, "at": at, "digit": digit, "value": value & ((1 << _DIGIT) - 1)})
                    value, digit = value >> _DIGIT, digit + 1
                if value:
                    out.append({"center": c, "at": at, "digit": digit, "value": -1})
        return out


def _narrow(vectors: np.ndarray) -> tuple[str, bytes]:
    """The smallest of three number types that holds the whole numbers."""
    most = np.abs(vectors).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, vectors.astype(kind).tobytes()


def _unpacked(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], dtype=row["kind"]).reshape(-1, dims).astype(np.float64)


def _blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """Blocks (block, ids, kind, vectors) of rows (id, v)."""
    most = max(1, BLOCK_BYTES // (8 * max(1, dims)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                kind, data = _narrow(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([kind]), pa.array([data], pa.binary())],
                    names=["block", "ids", "kind", "vectors"])
                block += 1

    return vectors.mapInArrow(pack, "block long, ids array<long>, kind string, vectors binary")


def _kept(df: DataFrame, buckets: int) -> str:
    """The name of a table of ``df`` in the shared folder, in buckets by block."""
    name = f"quillspark_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/quillspark/{name}"
    df.write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    return name


def _round(spark, table: str, bounds: str | None, centers: Centers, dims: int) -> DataFrame:
    """The bounds of all blocks under ``centers``; the last row of a task holds the sums that moved."""
    sent = spark.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, held = _Moves(), None
        schema = pa.schema([
            ("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("scanned", pa.int64()),
            ("moved", pa.list_(pa.struct([("center", pa.int32()), ("at", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())])))])
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                v, old, u, low = _unpacked(row, dims), None, None, None
                if row.get("cluster") is not None:
                    old, u, low = np.frombuffer(row["cluster"], np.int32), np.frombuffer(row["upper"]), np.frombuffer(row["lower"])
                cluster, u, low, scanned = settle(v, sent.value, old, u, low)
                changed = slice(None) if old is None else np.flatnonzero(cluster != old)
                moves.add(v[changed], cluster[changed], 1)
                if old is not None:
                    moves.add(v[changed], old[changed], -1)
                if held:
                    yield pa.RecordBatch.from_pylist([held], schema)
                held = {"block": row["block"], "cluster": cluster.tobytes(), "upper": u.tobytes(), "lower": low.tobytes(), "scanned": scanned, "moved": []}
        if held:
            yield pa.RecordBatch.from_pylist([held | {"moved": moves.rows()}], schema)

    rows = spark.table(table).select("block", "kind", "vectors")
    if bounds:
        old = spark.table(bounds).select("block", "cluster", "upper", "lower")
        rows = rows.join(old.hint("shuffle_hash"), "block")
    return rows.mapInArrow(run, _BOUNDS)


def _answers(spark, table: str, bounds: str, centers: Centers, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) with the exact squared distance to the centroid."""
    sent = spark.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                v, cluster = _unpacked(row, dims), np.frombuffer(row["cluster"], np.int32)
                distance = np.zeros(len(v), dtype=np.int64)
                for c in np.unique(cluster):
                    mine = np.flatnonzero(cluster == c)
                    distance[mine] = [min(int(d), _TOP) for d in distances(v[mine], sent.value.rows[c : c + 1])[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    both = spark.table(table).join(spark.table(bounds).select("block", "cluster").hint("shuffle_hash"), "block")
    return both.select("ids", "kind", "vectors", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), final centroids) of the vectors (vec_id, embedding) with ``dims`` finite components.

    Components become floor(scale * x). Centroids start as the ``k`` vectors whose ``seed`` and id have the smallest SHA-256
    (null ids last, equal ids by their vectors); fewer vectors: all of them. Ties go to the smaller number; a centroid
    becomes the floor of its vectors' mean, an empty one stays. Rows with a null id are clustered like all others, repeated
    rows each keep theirs, other columns take no part, an empty table gives no rows and no centroids. Arithmetic is exact
    at any size of components; the distance column stops at the limit of a long. Scales whose products leave the range
    of doubles raise an error.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, scale=scale, null_ids=True).where(F.size("v") == dims)
    seen = Observation()
    first = vectors.observe(seen, F.count(F.lit(1)).alias("n")).select("v", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("hash"))
    first = first.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    answer = T.StructType.fromDDL("vec_id long, cluster int, distance long")
    if not first:
        return spark.createDataFrame([], answer), []
    buckets = max(1, min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, math.ceil(seen.get["n"] * dims * 2 / bucket_bytes))))
    centers = Centers([[int(x) for x in r["v"]] for r in first])
    table = _kept(_blocks(vectors, dims).repartition(buckets, "block"), buckets)
    bounds, sums = None, {}
    for turn in range(rounds + 1):
        settled, old = _kept(_round(spark, table, bounds, centers, dims), buckets), bounds
        dropped(spark, old)
        bounds = settled
        if turn == rounds:
            break
        moved = spark.table(bounds).select(F.explode("moved").alias("m")).groupBy("m.center", "m.at", "m.digit").agg(F.sum("m.value").alias("value"))
        for center, at, digit, value in moved.collect():
            sums[center, at] = sums.get((center, at), 0) + (value << _DIGIT * digit)
        rows = [[sums.get((c, i), 0) // n for i in range(dims)] if (n := sums.get((c, -1), 0)) else list(centers.rows[c]) for c in range(len(first))]
        centers = Centers(rows, centers)
    found = written(_answers(spark, table, bounds, centers, dims), "centroid-rows")
    dropped(spark, table, bounds)
    return found, [list(map(int, r)) for r in centers.rows]


def with_inertia(found: DataFrame, centers: list[list[int]]) -> DataFrame:
    """``found`` of ``cluster_vectors`` with cluster_inertia, inertia and the digest of the centroid; sums stop at the limit of a long.

    The driver holds one row a centroid. An empty table stays empty.
    """
    import hashlib

    total = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    inertia = min(int(sum(total.values())), _TOP)
    rows = [(c, min(int(t), _TOP), inertia, hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for c, t in total.items()]
    table = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
