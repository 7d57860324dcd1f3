"""Parsing from SQL: table functions for bytes and OCR answers, and views of parsed tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.functions import udtf

from quillspark.operators.answers import register_answers
from quillspark.plans.parse import batch_summary, parse_documents
from quillspark.sources.documents import open_container, pdf_metadata


_OPENED = T.StructType([T.StructField("format", T.StringType()), T.StructField("broken", T.BooleanType()), T.StructField("text", T.StringType()),
                        T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])


@udtf(returnType=_OPENED)
class OpenDocument:
    """``open_document(content)``: what a container's or a PDF's bytes hold without OCR; no row for other bytes."""

    def eval(self, content: bytes):
        data = bytes(content or b"")
        if data.startswith(b"%PDF-"):
            yield "pdf", False, None, pdf_metadata(data)
        elif data.startswith(b"PK\x03\x04"):
            box = open_container(data)
            yield ("ofd" if box["is_ofd"] else "unknown"), box["broken"], box["text"], box["fields"]


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    spark.udtf.register("open_document", OpenDocument)
    register_answers(spark)


def parsed_view(spark: SparkSession, source: str, name: str, **options) -> DataFrame:
    """A temporary view ``name`` of the documents in the table or view ``source``, parsed."""
    parsed = parse_documents(spark.table(source), **options)
    parsed.createOrReplaceTempView(name)
    return parsed


def timed_batch(parsed: DataFrame, out: str) -> dict[str, int]:
    """Writes parsed documents as Parquet and says how many there were, how many failed, and how long it took."""
    began = time.perf_counter_ns()
    parsed.write.mode("overwrite").parquet(out)
    took = (time.perf_counter_ns() - began) // 1000
    total = batch_summary(parsed.sparkSession.read.parquet(out)).first().asDict()
    return total | {"elapsed_ms": took // 1000, "elapsed_us": took}
