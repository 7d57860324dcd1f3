"""Toxicity of every whole document, learned outside fold 0."""

from pyspark.sql import functions as F

from quillspark.llm.toxicity import fit, fold, score

NAME = "op2_toxicity_pu"
SQL = None  # a trained model


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
