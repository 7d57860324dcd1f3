"""Sharding by histogram sort: splitters from counted bytes, then one exchange.

The key of a row is (60 bits of MD5 of its text, 60 bits of MD5 of its id), so equal texts are neighbours. Rounds count the
exact bytes between candidate keys across all partitions and refine the bracket around each wanted byte position by further
probes, until it holds one text. A shard then ends at the nearer edge of that group of equal texts if it is within
``TOLERANCE`` of a shard, and else inside the group, where the same search goes on over the second key. The same search
with loose tolerance cuts shards into buckets for the exchange, hot groups included. Rows are exchanged once, by bucket;
counts per bucket give each row a gapless slot.

The driver holds counts per probe and the splitters, never keys of rows: at most ``MOST_PROBES`` for the brackets of one
depth together, so the more brackets are open, the fewer probes each has and the more rounds there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.storage import discarded, written

BITS, STEP = 60, 12
MOST_PROBES = 1 << 20
TOLERANCE = 0.01
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 1 << 16


def key60(value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


class _Target:
    """A wanted byte position and the bracket of keys that holds it."""

    def __init__(self, at: float, exact: bool):
        self.at, self.exact = at, exact
        self.group = None  # the text's key once the search is over the ids of one text
        self.shift, self.prefix, self.below = BITS, 0, 0
        self.cut = None  # (h, d): the first key beyond
        self.torn = False  # whether it wanted to cut inside rows of one text and one id

    def key(self, prefix: int, shift: int) -> tuple[int, int]:
        return (prefix << shift, -1) if self.group is None else (self.group, prefix << shift)

    def refine(self, bins: list[tuple[int, int, int, int, int]], shift: int, near: float) -> None:
        """bins: (bin, bytes, least key, greatest key, rows) of the bracket in order."""
        below = self.below
        for b, size, least, greatest, rows in bins:
            if below + size >= self.at:
                break
            below += size
        low, high = self.at - below, below + size - self.at
        if least == greatest:  # one text, or one row key
            if self.group is not None or min(low, high) <= near:
                first = least + (high < low)
                self.torn = rows > 1 and min(low, high) > near
                self.cut = (first, -1) if self.group is None else (self.group, first)
            else:
                self.group, self.shift, self.prefix, self.below = least, BITS, 0, below
        elif not self.exact and min(low, high) <= near:
            self.cut = self.key(b + (high < low), shift)
        else:
            self.shift, self.prefix, self.below = shift, b, below


def probe_bits(targets: int, brackets: int) -> int:
    """Bits by which a round refines each of ``brackets``: 16 probes a target where one bracket holds many targets."""
    wanted = max(STEP, math.ceil(targets / brackets).bit_length() + 4)
    return max(1, min(wanted, (MOST_PROBES // brackets).bit_length() - 1))


def splitters(keys: DataFrame, shards: int, bucket_bytes: int = BUCKET_BYTES) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(first keys of shards 1.., first keys of buckets 1.., whether repeated rows are too many to stay together) from a table (h, d, size)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(1 << BITS, -1)] * (shards - 1), [(1 << BITS, -1)] * (shards - 1), False
    buckets = min(MOST_BUCKETS, math.ceil(total / bucket_bytes))
    cuts = [_Target(total * i / shards, True) for i in range(1, shards)]
    loose = [_Target(total * i / buckets, False) for i in range(1, buckets)]
    near = {True: total / shards * TOLERANCE, False: total / buckets / 2}
    while active := [t for t in cuts + loose if t.cut is None]:
        for group, shift in {(t.group is not None, t.shift) for t in active}:
            mine = [t for t in active if (t.group is not None, t.shift) == (group, shift)]
            down = max(0, shift - probe_bits(len(mine), len({(t.group, t.prefix) for t in mine})))
            rows = keys
            if group:
                wanted = sorted({(t.group, t.prefix) for t in mine})
                one = rows.sparkSession.createDataFrame(wanted, "h long, p long")
                rows = rows.withColumn("p", F.shiftright("d", shift)).join(F.broadcast(one), ["h", "p"], "left_semi")
            elif shift < BITS:
                one = rows.sparkSession.createDataFrame([(p,) for p in sorted({t.prefix for t in mine})], "p long")
                rows = rows.withColumn("p", F.shiftright("h", shift)).join(F.broadcast(one), ["p"], "left_semi")
            column = "d" if group else "h"
            outer = F.col("h") if group else F.lit(0).cast("long")
            counted = rows.groupBy(outer.alias("g"), F.shiftright(column, down).alias("bin")).agg(
                F.sum("size"), F.min(column), F.max(column), F.count("*")).collect()
            by: dict = {}
            for g, b, *rest in sorted(counted):
                by.setdefault((g, b >> (shift - down)), []).append((b, *rest))
            for t in mine:
                t.refine(by[(t.group if group else 0, t.prefix)], down, near[t.exact])
    shard_cuts = [t.cut for t in cuts]
    return shard_cuts, sorted({*shard_cuts, *(t.cut for t in loose)}), any(t.torn for t in cuts + loose)


def _bucketed(df: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """``df`` (with h and d) with bucket, the number of ``cuts`` at or before a row's key. The cuts are broadcast by the first bits of the key."""
    bits = min(20, max(STEP, len(cuts).bit_length() + 2))
    inner: dict[int, list] = {}
    for c in cuts:
        inner.setdefault(min(c[0] >> (BITS - bits), (1 << bits) - 1), []).append(c)
    table, base = [], 0
    for b in range(1 << bits):
        table.append((b, base, inner.get(b, [])))
        base += len(inner.get(b, []))
    lookup = df.sparkSession.createDataFrame(table, "bin long, base int, inner array<struct<h:long,d:long>>")
    passed = F.filter("inner", lambda c: (c["h"] < F.col("h")) | ((c["h"] == F.col("h")) & (c["d"] <= F.col("d"))))
    joined = df.withColumn("bin", F.shiftright("h", BITS - bits)).join(F.broadcast(lookup), "bin")
    return joined.withColumn("bucket", F.col("base") + F.size(passed)).drop("bin", "base", "inner")


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (with doc_id) with size, shard and slot; columns of those names are replaced. Law: near equal bytes.

    Null texts have size 1 and group with empty ones. Rows that agree in text and id stay together unless they are too many for
    a shard or bucket; then the rows are numbered in a table, and the number counts with the id. Equal texts share a shard
    unless a shard's end falls inside their group. All other columns stay, whatever their names. An empty table gives
    an empty result.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): o for c, o in zip(docs.columns, own, strict=True)}
    body, doc_id = F.col(at[text.lower()]), F.col(at["doc_id"])
    keyed = docs.toDF(*own).withColumns({"h": key60(body), "d": key60(doc_id), "size": byte_size(body)})
    keys = written(keyed.select("h", "d", "size"), "shard-keys")
    shard_cuts, cuts, torn = splitters(keys, shards, bucket_bytes)
    if torn:
        discarded(keys)
        numbered = written(docs.toDF(*own).withColumn("number", F.monotonically_increasing_id()), "shard-rows")
        keyed = numbered.withColumns({"h": key60(body), "d": key60(F.concat_ws(" ", doc_id, "number")), "size": byte_size(body)})
        keys = written(keyed.select("h", "d", "size"), "shard-keys")
        shard_cuts, cuts, _ = splitters(keys, shards, bucket_bytes)
    counts = dict(_bucketed(keys, cuts).groupBy("bucket").count().collect())
    discarded(keys)
    places, slot, before = [], 0, -1
    for bucket in range(len(cuts) + 1):
        shard = sum(c <= cuts[bucket - 1] for c in shard_cuts) if bucket else 0
        slot = 0 if shard != before else slot
        places.append((bucket, shard, slot))
        slot, before = slot + counts.get(bucket, 0), shard
    places = docs.sparkSession.createDataFrame(places, "bucket int, shard int, first long")
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "d")) - 1
    kept = [F.col(at[c.lower()]).alias(c) for c in docs.columns if c.lower() not in {"size", "shard", "slot"}]
    return _bucketed(keyed, cuts).withColumn("inside", inside).join(F.broadcast(places), "bucket").select(
        *kept, "size", "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"))
