"""Mixing sources to target weights by systematic sampling.

A source's target is its share, by weight, of all words, at most ``MOST_COPIES`` times its size; what a stopped source
leaves goes to the others by weight. Each of its documents expects target / size copies. In a fixed order (size class,
then a hash of the id) the expected copies are summed up, one random offset per source is added, and a document is
emitted once for each integer that its stretch crosses. Expected copies are counted in 2^-20, so sums are exact.

The order by size class spreads the picks over small and large documents, so that a source's words differ from its target by
about the size of one of its largest documents at most.

The prefix sum is distributed: counts per (source, size class, group by the first digits of the hash) give each group its
start, and rows are ranked inside their group only. The digits grow with the number of rows, so that no group holds more than
about ``GROUP_ROWS``, be all texts of one source and one size; how many there are changes no result. Nor do the sources meet in
one task: they are numbered range by range, and the level is found by sums over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.storage import discarded, fresh, small_enough, written

UNIT = 1 << 20
MOST_COPIES = 3
BROADCAST_GROUPS = 500_000
GROUP_ROWS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` as a table with place: 0 for the first source by code point, null last. Only a count a partition goes to the driver."""
    none = F.col("source").isNull()
    dealt = sizes.repartitionByRange(none, "source").sortWithinPartitions(none, "source")
    rows = written(dealt.withColumns({"part": F.spark_partition_id(), "inside": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "mix-places")
    before, at = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("part").count().collect())):
        before.append((part, at))
        at += n
    known = sizes.sparkSession.createDataFrame(before, "part int, before long")
    placed = rows.join(F.broadcast(known), "part").select(*sizes.columns, (F.col("before") + F.col("inside")).alias("place"))
    out = written(placed, "mix-numbered")
    discarded(rows)
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target, rate) from one row (source, source_size) a source.

    Sources by code point, null last, weigh ``weights``, repeating. rate: expected copies of a document in 2^-20. Sources
    above the level of words a weight stop at their cap; the level rises by what they leave until none is above it.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    table = numbered(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST_COPIES).alias("cap"))
    exact = "decimal(38,0)"
    words, total = (int(x or 0) for x in table.agg(F.sum("source_size"), F.sum("weight")).first())
    left, weight_left = words, total

    def above():
        return F.col("cap").cast(exact) * F.lit(weight_left).cast(exact) < F.lit(left).cast(exact) * F.col("weight")

    while True:
        capped, heavy = (int(x or 0) for x in table.where(above()).agg(F.sum("cap"), F.sum("weight")).first())
        if (words - capped, total - heavy) == (left, weight_left):
            break
        left, weight_left = words - capped, total - heavy
    level = float(left) / weight_left if weight_left else 0.0
    target = F.when(above(), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") * float(UNIT) / F.col("source_size"))).otherwise(F.lit(0))
    return table.withColumn("target", target).select("source", "source_size", "target", rate.cast("long").alias("rate"))


def _start(source: Column) -> Column:
    """A fixed pseudo-random number under 2^20 for each source."""
    name = F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix-offset:"), name)), 1, 5), 16, 10).cast("long")


def _crossed(rate: Column, rank: Column, offset: Column) -> Column:
    """Integers that the stretch of the ``rank``-th document crosses."""
    def up_to(n):
        return F.shiftright(n * rate + offset, 20)

    return up_to(rank) - up_to(rank - 1)


def group_digits(rows: int) -> int:
    """Hex digits of the hash, at least one, that cut ``rows`` into groups of about ``GROUP_ROWS`` at most."""
    digits = 1
    while rows > GROUP_ROWS << 4 * digits:
        digits += 1
    return digits


def _placed(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """``docs`` with source, size, order, class and group."""
    digits = group_digits(docs.count())
    size_class = (F.length(F.bin("size")) * 16 + F.expr("shiftright(size, cast(greatest(length(bin(size)) - 4, 0) as int))")).cast("int")
    return (
        docs.withColumns({"size": word_count(F.col(text)), "source": F.col(source), "order": F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))})
        .withColumn("class", size_class).withColumn("group", F.substring("order", 1, digits)))


_KEY = ["source", "class", "group"]


def mix_sources(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = (1, 2, 3), prefix: str = "") -> DataFrame:
    """``docs`` (with doc_id and source) with size, source_size, target and copies; columns of those names are replaced.

    ``prefix`` goes before the new names; all other columns stay, whatever their names. Size is the number of words of the
    whole text; a null text has none. A source without words takes none; a document without words may have copies, which
    take no words. A null source is a source. Rows that agree in id and size are interchangeable. Reruns agree. An empty table
    gives an empty one.
    """
    added = {(prefix + c).lower() for c in ("size", "source_size", "target", "copies")}
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): o for c, o in zip(docs.columns, own, strict=True)}
    plain = docs.toDF(*own)
    placed = _placed(plain, at["doc_id"], at["source"], at[text.lower()])
    groups = placed.groupBy(*_KEY).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    groups = written(groups, "mix-groups")
    sources = source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    def earlier(*order):
        return F.coalesce(F.sum("n").over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    classes = groups.groupBy("source", "class").agg(F.sum("n").alias("n")).withColumn("before", earlier("source", "class"))
    classes = small_enough(written(classes, "mix-classes"), BROADCAST_GROUPS).alias("c")
    g = groups.withColumn("inner", earlier(*_KEY)).alias("g")
    groups_at = g.join(classes, F.col("g.source").eqNullSafe(F.col("c.source")) & (F.col("g.class") == F.col("c.class"))).select(
        *[f"g.{c}" for c in _KEY], (F.col("c.before") + F.col("g.inner")).alias("before"))
    starts = groups_at.alias("g").join(
        small_enough(sources, BROADCAST_GROUPS).alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))
    ).select("g.source", "g.class", "g.group", "g.before", "s.source_size", "s.target", "s.rate", _start(F.col("g.source")).alias("offset"))
    # A few hundred size classes of a source, each of 16 groups or more: one group a document at most, and joined as its size allows.
    starts = written(starts, "mix-starts")
    discarded(groups)
    inside = F.row_number().over(Window.partitionBy(*_KEY).orderBy("order", "size"))
    p, s = placed.withColumn("inside", inside).alias("p"), small_enough(starts, BROADCAST_GROUPS).alias("s")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _KEY]
    copies = _crossed(F.col("s.rate"), F.col("s.before") + F.col("p.inside"), F.col("s.offset"))
    return p.join(s, same[0] & same[1] & same[2]).select(
        *[F.col(f"p.{at[c.lower()]}").alias(c) for c in docs.columns if c.lower() not in added], F.col("p.size").alias(f"{prefix}size"),
        F.col("s.source_size").alias(f"{prefix}source_size"), F.col("s.target").alias(f"{prefix}target"), copies.alias(f"{prefix}copies"))


def emit(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """``columns`` of each row once for each of its ``copies``; null or no copies: not at all."""
    copy = fresh("copy", mixed)
    repeated = mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(f"`{copies}`").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in columns])
