"""Token counts of every whole document."""

from quillspark.llm.tokencount import token_counts

NAME = "op7_token_counts"
SQL = None  # no SQL has the library's tokens


def query(spark, sf_dir):
    import public_tokenizers  # here, so that other queries do without it

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
