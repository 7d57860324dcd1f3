"""Every document that holds a benchmark item, exact or edited."""

from quillspark.llm.decontam import contaminated

NAME = "op8_decontaminate"
SQL = None  # an alignment


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, items).select("doc_id", "item_id", "similarity", "start", "end")
