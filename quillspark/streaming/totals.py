"""Totals of a stream of parsed documents: what came in each window of time, by code, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_totals(parsed: DataFrame, out: str, checkpoint: str, delay: str, width: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts writing (opened, closed, code, n) of a stream (received, digest, code) to Parquet files at ``out``; codes of good documents are null.

    A document that is sent again within ``delay`` counts once; a window's totals are written once, when nothing that may still
    come belongs to it. Rows that come later than ``delay`` behind the latest one are dropped; see ``late_rows``. State holds the
    digests of the last ``delay`` and the open windows, whatever has passed.
    """
    once = parsed.withWatermark("received", delay).dropDuplicatesWithinWatermark(["digest"])
    counted = once.groupBy(F.window("received", width).alias("w"), "code").agg(F.count("*").alias("n"))
    rows = counted.select(F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "code", "n")
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(out)


def late_rows(query: StreamingQuery) -> int:
    """The rows that a finished or running query has dropped for coming too late, of the batches that it still reports."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
