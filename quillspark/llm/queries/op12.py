"""Licences of every whole document."""

from quillspark.llm.licensescan import find_licenses, license_digest

NAME = "op12_license_scan"
SQL = None  # expressions are parsed


def query(spark, sf_dir):
    return license_digest(find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
