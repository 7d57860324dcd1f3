"""Incremental parsing by content: a run parses what no earlier run of the same parser has.

The parsed table is its own ledger: each row carries the digest of what it was parsed from and the parser's version. Files of
a run appear when its tasks are committed; a run that is killed leaves whole rows or none, and the next run parses what is
missing. So runs may be repeated, and nothing is parsed or kept twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parsed_before(spark: SparkSession, out: str, version: str) -> DataFrame | None:
    """The rows that runs of the parser ``version`` have left at ``out``, one a digest; None if there is no table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/parser_version={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", out).parquet(f"{out}/parser_version={version}").dropDuplicates(["digest"])


def parse_new(docs: DataFrame, out: str, parse: Callable[[DataFrame], DataFrame], content: Column, version: str) -> None:
    """Parses the documents of ``docs`` whose ``content`` (string or binary) no run of ``version`` has parsed, and adds them at ``out``.

    ``parse`` must keep the column ``digest``. Documents of equal content are parsed once; null contents are none. Another version
    parses everything again, beside what there is.
    """
    named = docs.withColumn("digest", F.sha2(content, 256)).where("digest is not null").dropDuplicates(["digest"])
    done = parsed_before(docs.sparkSession, out, version)
    if done is not None:
        named = named.join(done.select("digest"), "digest", "left_anti")
    parse(named).withColumn("parser_version", F.lit(version)).write.mode("append").partitionBy("parser_version").parquet(out)


def parsed_of(docs: DataFrame, out: str, content: Column, version: str) -> DataFrame:
    """The columns of ``docs``, digest, and what was parsed from each document's content; null where no run has parsed it."""
    rows = parsed_before(docs.sparkSession, out, version)
    named = docs.withColumn("digest", F.sha2(content, 256))
    return named if rows is None else named.join(rows.drop("parser_version", *[c for c in docs.columns if c in rows.columns]), "digest", "left")
