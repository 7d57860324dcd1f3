"""All documents mixed to source weights 1, 2, 3."""

from pyspark.sql import functions as F

from quillspark.llm.mixing import mix_sources

NAME = "op9_source_mix"


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
p AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM p GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER r AS pos, sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
    sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT *, min(CASE WHEN l * weight <= cap * wl THEN pos END) OVER () AS free_at FROM o),
v AS (SELECT *, (SELECT CAST(l AS DOUBLE) / wl FROM f WHERE pos = free_at) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN pos < free_at THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target,
    CAST('0x' || substr(md5('mix-offset:' || CASE WHEN source IS NULL THEN '0' ELSE '1' END || coalesce(source, '')), 1, 5) AS BIGINT) AS u FROM v),
q AS (SELECT p.*, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target * 1048576.0 / t.source_size) AS BIGINT) ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY p.source ORDER BY class, substr(o, 1, 1), o, size) AS n FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (n * rate + u) // 1048576 - ((n - 1) * rate + u) // 1048576 AS copies FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM c
"""
