"""Mergeable summaries of batches: distinct counts and quantiles from sketches that are stored a batch and merged later."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LG_K = 14  # of the distinct counts: a standard error of about 0.8 %
KLL_K = 400  # of the quantiles: a rank error of about 0.7 %


def batch_sketches(records: DataFrame, batch: list[str], distinct: str, measure: str) -> DataFrame:
    """A row a batch: n, and sketches of the values of ``distinct`` and of the whole number ``measure``; nulls count in n only."""
    return records.groupBy(*batch).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(LG_K)).alias("distinct_sketch"),
        F.kll_sketch_agg_bigint(F.col(measure).cast("long"), F.lit(KLL_K)).alias("measure_sketch"))


def merged_sketches(batches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """A row a group of batches: n, the estimate n_distinct, and the quantiles of the measure at ``shares``. Only sketches are shuffled."""
    merged = batches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"), F.kll_merge_agg_bigint("measure_sketch").alias("merged"))
    return merged.select(*by, "n", "n_distinct", F.array(*[F.kll_sketch_get_quantile_bigint("merged", F.lit(s)) for s in shares]).alias("quantiles"))
