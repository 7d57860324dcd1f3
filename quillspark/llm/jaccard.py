"""N-gram Jaccard join by parity sketches, and its connected components.

A text's set holds its distinct n-word shingles. Texts of equal sets form a class at once; the join runs on classes.

Sketch: shingles are XOR-hashed into 64-bit words. In the folded sketch each flips one bit, so the Hamming distance of two
sketches is at most the symmetric difference of the sets. In the words of a size band each flips many bits of one word, so at
most as many words differ. A pair above the threshold differs in at most D = (x + y) * (1 - t) / (1 + t) shingles.
With more than D words at least one word of the two sketches is equal (pigeonhole), so classes that share no word of a size
band cannot be linked. Bands grow by a quarter; a class also visits the bands that its larger partners live in. Words without
any bit are equal for all sets, so they are no keys: a band has ``spare`` words more than it needs, and a pair of which one side
leaves at most ``spare`` words empty shares another word too. A class that leaves more empty, as small ones may, also goes by
a second sketch under another hash, and so on; only what has failed ``SKETCHES`` times, which random sets never do, sends them.

Candidates: classes that share a sketch word form a bucket. First each bucket pairs its least class with the others. A pair
whose folded sketches (512 bits) are too far apart is no link; nor is one of larger sets whose wide sketches, of two bits or more
a shingle, are. Of the rest each class is verified with the one it shares most
buckets with, on the whole sets, and then with others only while they are in different components. That joins most of each
group, without all pairs in it. What is left are buckets that still hold several components: their members are compared
across components by folded sketches, in cells of bounded size, and near pairs are verified as well. So a link between
components is lost nowhere, and no bucket lists its pairs.

A bucket's rows are combined before the shuffle: a batch pairs its own members with the least of them and sends on that
one only. Every step is a table in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillspark.llm.kernels import mix, segments, shingle_sets
from quillspark.llm.storage import discarded, fresh, renamed, small_enough, written

U64 = np.uint64
BROADCAST_ROWS = 300_000
FOLD_WORDS = 8  # 64-bit words of the folded sketch
SKETCHES = 12  # sketches of a set before empty words become keys
CHUNK = 1024  # members compared at a time
CELL = 4096  # members of a bucket that meet in one group; larger buckets are compared cell by cell
_KEY_BITS, _ID_BITS = 52, 12  # a bucket row packs the key and the upper bits of the class in one long


class Threshold:
    """Linked if den * common >= num * union."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("a similarity above 0, at most 1")
        self.num, self.den = num, den
        self.edges = [1]
        growth = max(1.25, den / num)
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * growth)))
        self._edges, self._plans = np.array(self.edges), {}

    def differ(self, x, y):
        """The largest symmetric difference of a linked pair of these sizes."""
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def _plan(self, band: int) -> tuple[int, int]:
        """(words, spare) of a band: as many spare words as its smallest visitor may be expected to leave empty, and two deviations."""
        if band not in self._plans:
            largest = self.edges[band + 1] - 1
            d, least = int(self.differ(largest, largest)), -(-self.edges[band] * self.num // self.den)
            spare = 1
            while spare <= d:
                empty = (d + 1 + spare) * math.exp(-least / (d + 1 + spare))
                if empty + 2 * math.sqrt(empty) <= spare:
                    break
                spare += 1 + spare // 16
            else:  # small sets: some have more empty words whatever their number; these take further sketches
                spare = 1 + d // 4
            self._plans[band] = (d + 1 + spare if d else 0, spare)
        return self._plans[band]

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(band, words, spare) of the band that ``size`` lives in and of those that it visits. Equal sets need none."""
        first, last = np.searchsorted(self._edges, [size, size * self.den // self.num], side="right") - 1
        return [(band, *self._plan(band)) for band in range(int(first), int(last) + 1) if self._plan(band)[0]]

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
            return False
        common = len(a) + len(b) - len(np.union1d(a, b))
        return self.den * common >= self.num * (len(a) + len(b) - common)


def sketch(shingles: np.ndarray, words: int, flips: np.ndarray) -> np.ndarray:
    """``words`` words; each shingle flips the bits ``flips`` of one of them."""
    out = np.zeros(words, dtype=U64)
    np.bitwise_xor.at(out, ((shingles >> U64(6)) % U64(words)).astype(np.int64), flips)
    return out


def bucket_keys(shingles: np.ndarray, t: Threshold) -> np.ndarray:
    """The keys, of ``_KEY_BITS`` bits, of the buckets that a set goes to."""
    keys, hashed = [np.zeros(0, dtype=U64)], {}
    for band, words, spare in t.bands(len(shingles)):
        for again in range(SKETCHES):
            if again not in hashed:
                dealt = mix(shingles + U64(again)) if again else shingles
                hashed[again] = dealt, mix(dealt)
            s = sketch(hashed[again][0], words, hashed[again][1])
            place = np.arange(words, dtype=U64) + U64((band << 44) + (again << 40))
            few = np.count_nonzero(s == 0) <= spare
            if few or again < SKETCHES - 1:
                place, s = place[s != 0], s[s != 0]
            keys.append(mix(s + mix(place)) >> U64(64 - _KEY_BITS))
            if few:
                break
    return np.concatenate(keys)


def folded_to(wide: np.ndarray, words: int) -> np.ndarray:
    """The sketch of ``words`` words of the set whose sketch of more words is ``wide``; both are powers of two."""
    return np.bitwise_xor.reduce(wide.reshape(-1, words), axis=0)


def wide_sketch(shingles: np.ndarray) -> np.ndarray:
    """A sketch with two bits or more a shingle, of ``FOLD_WORDS`` words at least and of a power of two."""
    words = FOLD_WORDS
    while words * 32 < len(shingles):
        words *= 2
    return sketch(shingles, words, U64(1) << (shingles & U64(63)))


def folded(shingles: np.ndarray) -> np.ndarray:
    """A sketch of ``FOLD_WORDS`` words, whatever the size of the set."""
    return folded_to(wide_sketch(shingles), FOLD_WORDS)


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """The class of a set: 12 and 64 bits."""
    low = int(shingles.sum(dtype=U64))
    high = int(mix(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))
    return high >> (64 - _ID_BITS), int(mix(np.array([low], dtype=U64))[0].view(np.int64))


def _features(docs: DataFrame, n: int, t: Threshold) -> DataFrame:
    """(doc_id, text_key, n_shingles, high, low, keys, sketch, wide): class, bucket keys, folded and wide sketch of each text.

    wide is null where it is the folded one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in segments(batch.column(2)):  # rows go on a megabyte of texts at a time
                sizes, high, low, keys, folds, wides = [], [], [], [], [], []
                for s in shingle_sets(data, offsets, n):
                    a, b = _fingerprint(s)
                    sizes.append(len(s))
                    high.append(a)
                    low.append(b)
                    keys.append(bucket_keys(s, t).tobytes())
                    wide = wide_sketch(s)
                    folds.append(folded_to(wide, FOLD_WORDS).view(np.int64))
                    wides.append(wide.tobytes() if len(wide) > FOLD_WORDS else None)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(row, len(sizes)).columns[:2], pa.array(sizes, pa.int64()), pa.array(high, pa.int32()), pa.array(low, pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(folds, pa.list_(pa.int64())), pa.array(wides, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "high", "low", "keys", "sketch", "wide"])

    own = T.StructType.fromDDL("text_key long, n_shingles long, high int, low long, keys binary, sketch array<long>, wide binary")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *own.fields]))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key and upper class bits, lower class bits) of all bucket rows of a batch (high, low, keys), sorted, repeats removed."""
    packed = batch.column(2).to_pylist()
    keys = np.frombuffer(b"".join(packed), dtype=U64)
    counts = np.array([len(x) // 8 for x in packed], dtype=np.int64)
    a = (keys << U64(_ID_BITS)) | np.repeat(batch.column(0).to_numpy().astype(U64), counts)
    b = np.repeat(batch.column(1).to_numpy(), counts)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _key_starts(a: np.ndarray) -> np.ndarray:
    key = a >> U64(_ID_BITS)
    start = np.ones(len(key), dtype=bool)
    start[1:] = key[1:] != key[:-1]
    return start


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ``counts`` values as one binary each."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _pairs(hub_a, hub_b, a, b) -> pa.RecordBatch:
    """Distinct rows (least class, other class), the number of buckets that they share, and the keys of these."""
    mask = U64((1 << _ID_BITS) - 1)
    rows = np.stack([(hub_a & mask).view(np.int64), hub_b, (a & mask).view(np.int64), b], axis=1)
    order = np.lexsort(rows.T)
    rows, keys = rows[order], (a >> U64(_ID_BITS))[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    shared = np.diff(np.append(np.flatnonzero(new), len(rows)))
    rows = rows[new]
    columns = [pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3]), pa.array(shared)]
    return pa.RecordBatch.from_arrays([*columns, _binary(keys, shared)], names=["high", "low", "high2", "low2", "shared", "keys"])


_PAIR = "high int, low long, high2 int, low2 long, shared long, keys binary"


def _local_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the members that share a bucket within a batch, each with the least."""
    for batch in batches:
        a, b = _unpacked(batch)
        start = _key_starts(a)
        hub = np.flatnonzero(start)[np.cumsum(start) - 1] if len(a) else np.zeros(0, dtype=np.int64)
        if not start.all():
            yield _pairs(a[hub][~start], b[hub][~start], a[~start], b[~start])


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least member of each bucket of a batch."""
    for batch in batches:
        a, b = _unpacked(batch)
        start = _key_starts(a)
        a, b = a[start], b[start]
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)].view(np.int64)), pa.array(b[at : at + (1 << 16)])], names=["a", "b"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the members of each bucket with the first; rows come dealt and sorted by bucket and stream through."""
    last_key, hub_a, hub_b = None, None, None
    for batch in batches:
        a, b = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
        if not len(a):
            continue
        start = _key_starts(a)
        held = last_key is not None and int(a[0] >> U64(_ID_BITS)) == last_key
        if held:
            a, b, start = np.insert(a, 0, hub_a), np.insert(b, 0, hub_b), np.insert(start, 0, True)
            start[1] = False
        hub = np.flatnonzero(start)[np.cumsum(start) - 1]
        last_key, hub_a, hub_b = int(a[-1] >> U64(_ID_BITS)), a[hub[-1]], b[hub[-1]]
        if not start.all():
            yield _pairs(a[hub][~start], b[hub][~start], a[~start], b[~start])


def _class(high: str = "high", low: str = "low"):
    return F.concat(F.lpad(F.hex(F.col(high).cast("long")), 3, "0"), F.lpad(F.hex(low), 16, "0"))


def _candidates(features: DataFrame) -> DataFrame:
    """(a, b, shared, keys): pairs of classes that share buckets, each with the least of a batch or bucket; a pair may repeat."""
    rows = features.select("high", "low", "keys").where("n_shingles > 0")
    inside = rows.mapInArrow(_local_pairs, _PAIR)
    sent = rows.mapInArrow(_sent, "a long, b long")
    dealt = sent.repartition(F.shiftrightunsigned("a", _ID_BITS)).sortWithinPartitions("a", "b")
    pairs = inside.unionByName(dealt.mapInArrow(_met, _PAIR)).where("high <> high2 or low <> low2")
    return pairs.select(_class().alias("a"), _class("high2", "low2").alias("b"), "shared", "keys")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(class, set): the packed shingles of each text of ``texts`` (class, text), so that no pair cuts a text again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                packed = [s.tobytes() for _, data, offsets in segments(part.column(1)) for s in shingle_sets(data, offsets, n)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["class", "set"])

    return texts.mapInArrow(run, "class string, set binary")


def _narrowed(pairs: DataFrame, wides: DataFrame, t: Threshold) -> DataFrame:
    """The ``pairs`` (a, b, ...) whose wide sketches are near enough to be linked; sets differ in as many shingles at least.

    wides: class, size, wide. Folded sketches of large sets are full and tell nothing; these grow with the sets, at a
    twentieth of their size. A pair of which one side is not in ``wides`` stays.
    """
    table = small_enough(wides, BROADCAST_ROWS // 4)
    sides = {x: table.select(F.col("class").alias(x), F.struct("size", "wide").alias(f"of_{x}")) for x in ("a", "b")}
    both = pairs.join(sides["a"], "a", "left").join(sides["b"], "b", "left").select(*pairs.columns, "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [c.field(0).to_pylist() for c in batch.columns[-2:]]
            words = [c.field(1) for c in batch.columns[-2:]]
            known, keep = [c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[-2:]], np.ones(len(batch), dtype=bool)
            for i in np.flatnonzero(known[0] & known[1]):
                x, y = (np.frombuffer(c[int(i)].as_buffer(), dtype=U64) for c in words)
                least = min(len(x), len(y))
                apart = int(np.bitwise_count(folded_to(x, least) ^ folded_to(y, least)).sum())
                keep[i] = apart <= t.differ(sizes[0][i], sizes[1][i])
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns[:-2], names=batch.schema.names[:-2])

    return both.mapInArrow(run, pairs.schema)


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """``pairs`` (a, b) with linked, decided on the whole sets, of ``_sets``."""
    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [t.linked(*(np.frombuffer(x.as_buffer(), dtype=U64) for x in row)) for row in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a string, b string, linked boolean").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the least node that is connected with it.

    Large-star and small-star steps in turn; they take a logarithmic number of rounds. They end when each node is the least
    of its star or has one neighbour, which the first table of a round shows; that table holds the roots then.
    """
    def both_ways(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def named(e: DataFrame, least: DataFrame) -> DataFrame:
        """``e`` with the root of its a. Both sides are tables, so that a node with very many edges can be split at run time."""
        return e.join(small_enough(least, BROADCAST_ROWS), "a")

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    while True:
        least = both_ways(now).groupBy("a").agg(F.min("b").alias("b"), F.count_if(F.col("b") < F.col("a")).alias("below"), F.count("*").alias("n"))
        least = least.select("a", F.least("a", "b").alias("root"), F.expr("below > 1 or below = 1 and n > 1").alias("open"))
        least = written(least, "components-least", open=F.count_if("open"))
        if not least.facts[0]:
            discarded(now)
            out = least.select(F.col("a").alias("node"), "root")
            out.written_size = least.written_size
            return out
        # large star: the larger neighbours of a node go to the least of its neighbours and itself
        large = named(both_ways(now).where("b > a"), least).select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        large = written(large, "components-large")
        discarded(now, least)
        # small star: the smaller neighbours of a node and itself go to the least of them
        least = written(large.groupBy("a").agg(F.min("b").alias("root")), "components-least")
        small = named(large, least).select(F.explode(F.array("a", "b")).alias("x"), "root").where("x <> root")
        now = written(small.select(F.col("x").alias("a"), F.col("root").alias("b")).distinct(), "components")
        discarded(large, least)


def trees(pointers: DataFrame) -> DataFrame:
    """(node, root) for each node of a forest: ``pointers`` (a, b) name the parent a of each b, once a b and without circles.

    Every step doubles the way that all nodes have gone, so it takes the logarithm of the depth.
    """
    now, moved = written(pointers.select(F.col("b").alias("node"), F.col("a").alias("root")), "components"), 1
    while moved:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        up.written_size = now.written_size
        step = now.select("node", "root").join(small_enough(up, BROADCAST_ROWS), "root", "left")
        step = step.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = written(step, "components-up", moved=F.count_if("moved"))
        discarded(now)
        now, moved = step, step.facts[0]
    roots = now.select("node", "root")
    out = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components-roots")
    discarded(now)
    return out


def _sketches_near(t: Threshold, x: str, y: str):
    """Whether a pair may be linked, by the sizes and folded sketches of its sides; columns ``size_*`` and ``sketch_*``."""
    size_x, size_y = F.col(f"size_{x}"), F.col(f"size_{y}")
    bits = F.zip_with(f"sketch_{x}", f"sketch_{y}", lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    apart = F.aggregate(bits, F.lit(0), lambda n, k: n + k)
    fits = F.least(size_x, size_y) * t.den >= F.greatest(size_x, size_y) * t.num
    return fits & (apart * (t.den + t.num) <= (size_x + size_y) * (t.den - t.num))


def _sides(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``table`` (class, ...) for both sides, named with _a and _b."""
    table = small_enough(table, BROADCAST_ROWS // 4)
    for side in ("a", "b"):
        named = table.select(F.col("class").alias(side), *[F.col(c).alias(f"{new}_{side}") for c, new in columns.items()])
        pairs = pairs.join(named, side, "left")
    return pairs


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with root_a and root_b; a class without links is its own root."""
    named = _sides(pairs, renamed(roots, {"node": "class"}), {"root": "root"})
    return named.withColumns({f"root_{x}": F.coalesce(f"root_{x}", x) for x in ("a", "b")})


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sides are in different components, with root_a and root_b."""
    return _rooted(pairs, roots).where("root_a <> root_b")


def _forest(pairs: list[tuple[int, int, int]], part: np.ndarray) -> list[tuple[int, int]]:
    """Of (distance, i, j) the pairs that join components which no nearer pair has joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    kept = []
    for _, i, j in sorted(pairs):
        a, b = root(int(part[i])), root(int(part[j]))
        if a != b:
            up[a] = b
            kept.append((i, j))
    return kept


def _mixed(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, class): the members of the buckets that hold several components. met: of ``_candidates``.

    A bucket holds several if some member's component is not that of the least it was paired with. All other buckets, most
    of them, go no further. Of those with two members nothing is left to compare. Texts that share much share many buckets:
    of buckets with the same members one stays.
    """
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(0).to_pylist()
            rows = np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed])
            keys = np.frombuffer(b"".join(packed), dtype=np.int64)
            for at in range(0, len(rows), 1 << 16):
                picked = pa.array(rows[at : at + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), *[c.take(picked) for c in batch.columns[1:]]], names=["key", *batch.schema.names[1:]])

    apart = _apart(met, roots)
    keys = written(apart.select("keys").mapInArrow(unpacked, "key long").distinct(), "jaccard-mixed")
    touched = written(apart.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct(), "jaccard-touched")
    named = _rooted(met, roots)
    for side in ("a", "b"):
        named = named.join(small_enough(renamed(touched, {"root": f"root_{side}"}), BROADCAST_ROWS), f"root_{side}", "left_semi")
    rows = named.select("keys", "a", "b").mapInArrow(unpacked, "key long, a string, b string")
    rows = rows.join(small_enough(keys, BROADCAST_ROWS), "key", "left_semi")
    rows = written(rows.select("key", F.explode(F.array("a", "b")).alias("class")).distinct(), "jaccard-members")
    discarded(keys, touched)
    hashes = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"members_{i}") for i in (0, 1)]
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), *hashes).where("n > 2")
    kept = written(buckets.groupBy("n", "members_0", "members_1").agg(F.min("key").alias("key")).select("key"), "jaccard-buckets")
    once = written(rows.join(small_enough(kept, BROADCAST_ROWS), "key", "left_semi"), "jaccard-members")
    discarded(rows, kept)
    return once


def _across(members: DataFrame, nodes: DataFrame, t: Threshold, every: bool) -> DataFrame:
    """(a, b): pairs of classes in one bucket, of different components, whose folded sketches are near enough to be linked.

    members: key, class, of ``_mixed``; nodes: class, root, size, sketch. Unless ``every``, a bucket gives only the nearest
    pairs that would join its components, fewer than it has members.
    """
    parted = members.join(small_enough(nodes, BROADCAST_ROWS // 4).select("class", F.xxhash64("root").alias("part")), "class")
    mixed = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    mixed = mixed.where("low <> high and n > 2")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    rows = members.join(mixed.select("key", cells.alias("cells")), "key").select("key", "class", "cells")
    own = F.pmod(F.xxhash64("class"), F.col("cells")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "class")
    words = [F.col("sketch")[w].alias(f"w{w}") for w in range(FOLD_WORDS)]
    known = small_enough(nodes, BROADCAST_ROWS // 4).select("class", F.xxhash64("root").alias("part"), "size", *words)
    dealt = rows.join(known, "class").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "class")

    def near(group: np.ndarray, names: pa.Array, part: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray]) -> pa.RecordBatch:
        """The pairs of rows of one group; ``group`` rises. Pairs are judged ``CHUNK`` squared at a time."""
        ends = np.searchsorted(group, group, side="right")
        later = ends - np.arange(len(group)) - 1  # rows of its group behind each
        up_to, found = np.cumsum(later), []
        at = 0
        while at < len(group):
            begun = int(up_to[at] - later[at])
            stop = max(at + 1, int(np.searchsorted(up_to, begun + CHUNK * CHUNK, side="right")))
            k = np.repeat(np.arange(at, stop), later[at:stop])
            m = k + 1 + np.arange(len(k)) - np.repeat(up_to[at:stop] - later[at:stop] - begun, later[at:stop])
            x, y = sizes[k], sizes[m]
            fits = np.flatnonzero((part[k] != part[m]) & (t.den * np.minimum(x, y) >= t.num * np.maximum(x, y)))
            k, m, most = k[fits], m[fits], t.differ(x[fits], y[fits])
            apart = np.zeros(len(k), dtype=np.int64)
            for word in bits:
                apart += np.bitwise_count(word[k] ^ word[m])
            fits = apart <= most
            found.append((group[k[fits]], apart[fits], k[fits], m[fits]))
            if not every and sum(len(f[0]) for f in found) > CHUNK * CHUNK:
                found = [joining(found, part)]
            at = stop
        if not every:
            found = [joining(found, part)]
        k, m = (np.concatenate([f[i] for f in found] or [np.zeros(0, dtype=np.int64)]) for i in (2, 3))
        pairs = {(min(a, b), max(a, b)) for a, b in zip(names.take(pa.array(k)).to_pylist(), names.take(pa.array(m)).to_pylist(), strict=True)}
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["a", "b"])

    def joining(found: list[tuple[np.ndarray, ...]], part: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of (group, distance, i, j) of pairs those that ``_forest`` keeps of each group."""
        group, apart, k, m = (np.concatenate([f[i] for f in found] or [np.zeros(0, dtype=np.int64)]) for i in range(4))
        order = np.lexsort((m, k, apart, group))
        group, apart, k, m = group[order], apart[order], k[order], m[order]
        kept = []
        for run in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
            rows = zip(apart[run].tolist(), k[run].tolist(), m[run].tolist(), strict=True)
            chosen = set(_forest(list(rows), part))
            kept += [i for i in run.tolist() if (int(k[i]), int(m[i])) in chosen]
        kept = np.array(kept, dtype=np.int64)
        return group[kept], apart[kept], k[kept], m[kept]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not len(batch):
                continue
            key, low, high = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            held = batch.slice(int(new[-1]) if len(new) else 0)  # its group may go on
            if len(new):
                yield judged(batch.slice(0, int(new[-1])), new[:-1])
        if held is not None:
            yield judged(held, np.zeros(0, dtype=np.int64))

    def judged(batch: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        group = np.zeros(len(batch), dtype=np.int64)
        group[new] = 1
        return near(np.cumsum(group), batch.column(3), *(batch.column(i).to_numpy() for i in (4, 5)), [batch.column(i).to_numpy().view(U64) for i in range(6, 6 + FOLD_WORDS)])

    return dealt.select("key", "low", "high", "class", "part", "size", *[f"w{w}" for w in range(FOLD_WORDS)]).mapInArrow(compare, "a string, b string").distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id) for each row of ``docs`` (doc_id, text); links: Jaccard >= num / den.

    component_id is the least doc_id reachable by links, the row's own included; null ids count for nothing there. Null texts
    and texts without words have no shingles and no links: their component is their own id. Fewer than ``n`` words: the whole
    sequence is one shingle. Ids may be of any type that sorts. Texts of any length are read whole; other columns take no
    part; an empty table gives no rows. Repeated rows each keep a row. text_key is xxhash64 of the text, for joins back to it;
    component names the component, null without shingles.
    """
    t = Threshold(num, den)
    spread = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    keyed = written(_features(spread, n, t), "jaccard-keys")
    met = written(_candidates(keyed), "jaccard-met")
    features = written(keyed.drop("keys", "wide"), "jaccard-features")
    pairs = written(met.groupBy("a", "b").agg(F.sum("shared").alias("shared")), "jaccard-pairs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", F.col("n_shingles").alias("size"), "sketch")).alias("first")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "jaccard-wanted")
    classed = features.where("n_shingles > 0").withColumn("class", _class())
    nodes = classed.join(small_enough(wanted, BROADCAST_ROWS), "class", "left_semi").groupBy("class").agg(first)
    nodes = written(nodes.select("class", "first.*"), "jaccard-nodes")
    wides = keyed.where("wide is not null").select(_class().alias("class"), F.struct(F.col("n_shingles").alias("size"), "wide").alias("first"))
    wides = wides.join(small_enough(wanted, BROADCAST_ROWS), "class", "left_semi").groupBy("class").agg(F.min("first").alias("first"))
    wides = written(wides.select("class", "first.*"), "jaccard-wides")
    discarded(wanted, keyed)

    def sets_of(checked: DataFrame) -> DataFrame:
        classes = checked.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        named = written(nodes.join(classes, "class").select("class", "doc_id", "text_key"), "jaccard-named")
        d, s = spread.alias("d"), small_enough(named, BROADCAST_ROWS).alias("s")
        same = (F.col("d.text_key") == F.col("s.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
        sets = written(_sets(d.join(s, same).select("s.class", "d.text"), n), "jaccard-sets")
        discarded(named)
        return sets

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        """``roots`` after ``links``: only the components that these join are worked on."""
        between = _apart(links.select("a", "b"), roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        merged = components(between)
        moved = roots.join(small_enough(renamed(merged, {"root": "onto"}), BROADCAST_ROWS).withColumnRenamed("node", "root"), "root", "left")
        new = merged.join(small_enough(roots, BROADCAST_ROWS).select("node"), "node", "left_anti")
        both = written(moved.select("node", F.coalesce("onto", "root").alias("root")).unionByName(new.select("node", "root")), "components-roots")
        discarded(roots, merged)
        return both

    near = _sides(pairs, nodes, {"size": "size", "sketch": "sketch"}).where(_sketches_near(t, "a", "b")).select("a", "b", "shared")
    folded_near = written(near, "jaccard-near")
    near = written(_narrowed(folded_near, wides, t), "jaccard-near")
    discarded(folded_near)
    sets = sets_of(near)
    best = near.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select("best.a", "b")
    checked = written(_verified(best, sets, t), "jaccard-checked")
    roots = trees(checked.where("linked"))  # the least class of a batch or bucket is the parent, and comes before all its members
    rest = _apart(near.select("a", "b").join(checked, ["a", "b"], "left_anti"), roots).select("a", "b")
    again = written(_verified(rest, sets, t), "jaccard-checked", linked=F.count_if("linked"))
    discarded(sets, checked, near)
    if again.facts[0]:
        roots = joined(roots, again.where("linked"))
    discarded(again)
    discarded(pairs)
    # buckets that still hold several components
    members = _mixed(met, roots)
    discarded(met)
    failed = None
    for every in (False, True) if members.written_size[0] else ():
        parted = nodes.join(small_enough(renamed(roots, {"node": "class"}), BROADCAST_ROWS), "class", "left")
        parted = parted.select("class", F.coalesce("root", "class").alias("root"), "size", "sketch")
        parted = written(parted.join(members.select("class").distinct(), "class", "left_semi"), "jaccard-open")
        across = _across(members, parted, t, every)
        if every:  # what the nearest pairs have not joined
            across = across.join(failed, ["a", "b"], "left_anti")
        across = written(across, "jaccard-across")
        discarded(parted)
        found = across.written_size[0]
        if not found:
            break
        narrowed = written(_narrowed(across, wides, t), "jaccard-across")
        sets = sets_of(narrowed)
        checked = written(_verified(narrowed, sets, t), "jaccard-checked", linked=F.count_if("linked"))
        discarded(across, narrowed, sets)
        if checked.facts[0]:
            roots = joined(roots, checked.where("linked"))
        failed = checked.where("not linked")
        if checked.facts[0] == found:
            break
    discarded(members, wides)
    # the least id of each component, class by class: no step deals documents, or the classes of one component, to one task
    owns = classed.groupBy("class").agg(F.min("doc_id").alias("own"), F.count("*").alias("n"))
    classes = owns.join(roots.withColumnRenamed("node", "class"), "class", "left").where("n > 1 or root is not null").drop("n")
    classes = written(classes, "jaccard-classes")
    least = written(classes.where("root is not null").groupBy("root").agg(F.min("own").alias("least")), "jaccard-least")
    linked = classes.join(small_enough(least, BROADCAST_ROWS), "root").select("class", "root", "least")
    places = linked.unionByName(classes.where("root is null").select("class", F.col("class").alias("root"), F.col("own").alias("least")))
    places = written(places, "jaccard-places")
    discarded(nodes, roots, classes, least)
    keyed = features.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, _class()).alias("class"))
    keyed = keyed.join(small_enough(places, BROADCAST_ROWS), "class", "left")
    component_id = F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return keyed.select("doc_id", "text_key", "n_shingles", F.coalesce("root", "class").alias("component"), component_id.alias("component_id"))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component of ``found``: least doc_id (null last), then least text key, one of repeated rows.

    Rows without shingles (null and empty texts) are near no other; all stay, as do all columns, whatever their names.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    rows = found.where("component is not null").select("component", "doc_id", "text_key", place.alias("place"))
    first = rows.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.countDistinct("place").alias("places"))
    first = written(first.where("n > 1"), "jaccard-first", repeated=F.count_if(F.col("n") > F.col("places")))
    gone = rows.join(small_enough(first, BROADCAST_ROWS), "component").where("place <> first").select("doc_id", "text_key").distinct()
    gone = small_enough(written(gone, "jaccard-gone"), BROADCAST_ROWS).alias("g")
    key = fresh("text_key", docs)
    d = docs.withColumn(key, F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{key}") == F.col("g.text_key"))
    left = d.join(gone, same, "left_anti")
    if first.facts[0]:  # some row is repeated as a whole
        has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        left = left.where(~has_words).unionByName(left.where(has_words).dropDuplicates(["doc_id", key]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
