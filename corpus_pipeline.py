"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

All stages: rows with null, empty or very long texts and null ids are judged as the stage's operator says; repeated rows are
judged alike; other columns stay as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.decontam import contaminated, without
from quillspark.llm.jaccard import jaccard_components, keep_first
from quillspark.llm.mixing import emit, mix_sources
from quillspark.llm.sharding import shard_by_bytes
from quillspark.llm.storage import fresh_prefix, written
from quillspark.llm.toxicity import fit, score

ORACLE_SQL = None  # a trained model and an alignment are not SQL


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from all folds but the held-out one.

    A null or empty text has the score of the bias alone, which the prior keeps low.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = fresh_prefix(docs)
    scored = score(docs, model, prefix=prefix)
    return scored.where(F.col(f"{prefix}predicted") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under similarity 0.8 of 5-word shingles: the least id, null last.

    Documents without words are near no other and all stay; of wholly repeated rows with words one stays.
    """
    return keep_first(docs, jaccard_components(docs.select("doc_id", "text"), 5, 8, 10))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item; those without words stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return without(docs, contaminated(docs.select("doc_id", "text"), items))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times; a null source is a source."""
    prefix = fresh_prefix(docs)
    return emit(mix_sources(docs, prefix=prefix), docs.columns, f"{prefix}copies")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, shard and slot, in eight shards of near equal bytes; a null text has size 1."""
    return shard_by_bytes(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
