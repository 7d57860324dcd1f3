"""Joins of records with registries by time and by range, cut at quantiles so that no key and no range is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _cuts(values: DataFrame, n: int) -> list:
    """At most ``n`` - 1 different quantiles of the one column of ``values``, of its own type."""
    found = values.agg(F.percentile_approx(F.col(values.columns[0]), [i / n for i in range(1, n)], 100 * n)).first()[0]
    return sorted({x for x in found or [] if x is not None})


def _place(x: Column, cuts: list) -> Column:
    """The number of ``cuts`` at or below ``x``, by halving; 0 for null. Compiled, unlike a filter over an array."""
    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x >= cuts[middle], half(middle + 1, high)).otherwise(half(low, middle))

    return half(0, len(cuts))


def as_of(records: DataFrame, registry: DataFrame, key: str, at: str, since: str, columns: list[str], parts: int = 64) -> DataFrame:
    """``records`` with ``columns`` of the registry's row of the same key that holds at the time ``at``: the last with ``since`` <= ``at``.

    Times are cut at quantiles of both tables. Within a key and part a window carries the last row on; the parts before are
    summed up in a row each, so a window holds a key's rows of one part, or one row a part. Of rows of one key and time the one
    that sorts last counts. Without a row, or with a null key or time, the columns are null; repeated records each stay.
    """
    moment = records.schema[at].dataType
    entries = registry.where(F.col(key).isNotNull() & F.col(since).isNotNull()).groupBy(F.col(key).alias("k_"), F.col(since).cast(moment).alias("t_")).agg(
        F.max(F.struct(*columns)).alias("entry_"))
    times = records.select(F.col(at).cast("timestamp").cast("long").alias("t")).unionByName(entries.select(F.col("t_").cast("timestamp").cast("long").alias("t")))
    cuts = _cuts(times, parts)

    def part(t: str) -> Column:
        return _place(F.col(t).cast("timestamp").cast("long"), cuts).alias("part_")

    entries = entries.select("*", part("t_"))
    told = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record_"), F.col(key).alias("k_"), F.col(at).alias("t_"), part(at))
    none, no_record = F.lit(None).cast(entries.schema["entry_"].dataType), F.lit(None).cast(told.schema["record_"].dataType)
    last = entries.groupBy("k_", "part_").agg(F.max_by("entry_", "t_").alias("last_"))
    places = last.unionByName(told.select("k_", "part_", none.alias("last_"))).groupBy("k_", "part_").agg(F.max("last_").alias("last_"))
    before = Window.partitionBy("k_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("carried_", F.last("last_", ignorenulls=True).over(before)).drop("last_")
    rows = told.select("k_", "t_", "part_", F.lit(1).alias("rank_"), none.alias("entry_"), "record_").unionByName(
        entries.select("k_", "t_", "part_", F.lit(0).alias("rank_"), "entry_", no_record.alias("record_")))
    inside = Window.partitionBy("k_", "part_").orderBy("t_", "rank_").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("entry_", F.last("entry_", ignorenulls=True).over(inside)).where("rank_ = 1").join(carried, ["k_", "part_"], "left")
    held = F.when(F.col("k_").isNotNull() & F.col("t_").isNotNull(), F.coalesce("entry_", "carried_"))
    return found.withColumn("entry_", held).select("record_.*", *[F.col("entry_")[c].alias(c) for c in columns])


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, parts: int = 256) -> DataFrame:
    """``points`` joined with each row of ``ranges`` with ``low`` <= ``at`` < ``high``; column names of the two differ.

    Both ends of the ranges are cut at quantiles. A point goes to its part, a range to each part that it touches, and they meet
    by the part; so a task compares points and ranges of one part only. Nulls meet nothing; repeated rows each count.
    """
    ends = ranges.select(F.col(low).alias("x")).unionByName(ranges.select(F.col(high).alias("x")))
    cuts = _cuts(ends, parts)
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("part_", F.explode(F.sequence(_place(F.col(low), cuts), _place(F.col(high), cuts))))
    placed = points.where(F.col(at).isNotNull()).withColumn("part_", _place(F.col(at), cuts))
    return placed.join(spread, "part_").where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("part_")
