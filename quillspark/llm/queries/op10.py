"""Secrets of every whole document."""

from quillspark.llm.secretscan import find_secrets, secret_digest

NAME = "op10_secret_scan"
SQL = None  # the token test needs the vocabulary


def query(spark, sf_dir):
    import public_tokenizers  # here, so that other queries do without it

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secret_digest(find_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))
