"""Mining queries: op11 (collocations), op12 (centroids), op13 (suffix-array dedup)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, collocations, suffix_dedup
from .common import table


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {"op11_collocations": op11_collocations, "op12_centroids": op12_centroids, "op13_suffix_dedup": op13_suffix_dedup}


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
      FROM w, (SELECT CAST(unnest(range(1, 5)) AS INT) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.k, cut.a, cut.j, l.a AS l, r.a AS r, (2000000::HUGEINT * cut.a) // (l.a + r.a) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(list_slice(w, 1, j), ' ')
               JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(list_slice(w, j + 1, cut.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
covered AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c o ON o.lang = b.lang AND o.k > b.k
            AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * o.a >= 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM b ANTI JOIN covered USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000"""


def _op12_sql() -> str:
    parts = ["""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT rid, unnest(v) AS x, unnest(range(1, 65)) AS d FROM v),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM v
       QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16)"""]
    for i in range(4):
        parts.append(f"""
a{i} AS (SELECT rid, c, dist FROM (
  SELECT rid, c, list_sum(list_transform(list_zip(v.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
  FROM v, c{i} k) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1)""")
        if i < 3:
            parts.append(f"""
m{i} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN e USING (rid) GROUP BY c, d),
g{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY d) AS v FROM m{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(g.v, k.v) AS v FROM c{i} k LEFT JOIN g{i} g USING (c))""")
    return ",".join(parts) + """
SELECT v.vec_id, CAST(c AS INT) AS cluster, CAST(dist AS BIGINT) AS distance,
       CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a3 JOIN v USING (rid) JOIN c3 k USING (c)"""


OP12_SQL = _op12_sql()


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": OP11_SQL, "op12_centroids": OP12_SQL}
