"""All embeddings in 40 clusters after five rounds."""

from quillspark.llm.hamerly import cluster_vectors, with_inertia

NAME = "op11_hamerly_clusters"
K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256


def query(spark, sf_dir):
    return with_inertia(*cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), K, ROUNDS, DIMS, SCALE))


def _sql() -> str:
    """Each round as its own tables: nearest centroid of every vector, then floors of means."""
    apart = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))".format(d=DIMS)
    parts = [f"""
v AS (SELECT row_number() OVER () AS r, vec_id, v FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {K}))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, min(({apart}, c.c)) AS best FROM v, c{i} c GROUP BY r, vec_id)")
        if i < ROUNDS:
            parts.append(f"""m{i} AS (SELECT c, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT a.best[2] AS c, place, sum(v.v[place]) AS s, count(*) AS n
  FROM a{i} a JOIN v USING (r), range(1, {DIMS} + 1) AS t(place) GROUP BY 1, 2)),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(x ORDER BY place) AS v FROM m{i} GROUP BY c) m ON m.c = c.c)""")
    last = f"""SELECT a.vec_id, CAST(a.best[2] AS INT) AS cluster, CAST(a.best[1] AS BIGINT) AS distance,
  CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.best[2]"""
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = _sql()
