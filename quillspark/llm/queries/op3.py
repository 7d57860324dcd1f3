"""All documents in eight shards of near equal bytes."""

from pyspark.sql import functions as F

from quillspark.llm.sharding import shard_by_bytes

NAME = "op3_histogram_shards"


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return shard_by_bytes(docs.withColumn("text_crc32", crc)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH one AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
d AS (SELECT doc_id, coalesce(text, '') AS t, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS d, strlen(coalesce(text, '')) + 1 AS size FROM documents),
x AS (SELECT *, hex(encode(t)) AS bytes FROM d),
y AS (SELECT x.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(bytes, '..'),
    lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8))) AS crc FROM x, one),
k AS (SELECT h, d, sum(size) AS s FROM d GROUP BY h, d),
c AS (SELECT *, sum(s) OVER (ORDER BY h, d) AS e FROM k),
g AS (SELECT h, min(e - s) AS a, max(e) AS b FROM c GROUP BY h),
w AS (SELECT i, (SELECT sum(s) FROM k) * i / 8.0 AS pos, (SELECT sum(s) FROM k) / 8.0 * 0.01 AS near FROM range(1, 8) r(i)),
wg AS (SELECT w.*, g.*, row_number() OVER (PARTITION BY i ORDER BY b) AS n FROM w JOIN g ON g.b >= w.pos),
wk AS (SELECT wg.*, c.d AS kd, c.e - c.s AS ka, c.e AS kb, row_number() OVER (PARTITION BY i ORDER BY c.e) AS kn
    FROM wg JOIN c ON c.h = wg.h AND c.e >= wg.pos WHERE n = 1),
cut AS (SELECT CASE WHEN least(pos - a, b - pos) <= near THEN h + CASE WHEN b - pos < pos - a THEN 1 ELSE 0 END ELSE h END AS ch,
    CASE WHEN least(pos - a, b - pos) <= near THEN -1 ELSE kd + CASE WHEN kb - pos < pos - ka THEN 1 ELSE 0 END END AS cd FROM wk WHERE kn = 1),
placed AS (SELECT doc_id, size, crc, h, d, (SELECT count(*) FROM cut WHERE ch < h OR (ch = h AND cd <= d)) AS shard FROM y)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY h, d) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed
"""
