"""Corpus queries: op1 (mixing), op2 (n-gram join), op3 (byte-level BPE),
op5 (repeated passages), op6 (toxicity)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, ngram_join, substring_dedup, toxicity
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.sample(mixing.plan(docs))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def digests(docs: DataFrame, *keep: str) -> DataFrame:
    """Encodes and decodes ``text``; ids and bytes as digests beside the columns ``keep``."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode(docs, path, pattern, decoded="decoded")
    return both.select(*keep, F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return substring_dedup.passages(found)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def queries() -> dict:
    return {"op1_mixing": op1_mixing, "op2_ngram_join": op2_ngram_join, "op3_bpe": op3_bpe,
            "op5_substring_dedup": op5_substring_dedup, "op6_toxicity": op6_toxicity}


def _md5(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15)) AS BIGINT)"


_GRID = 1 << mixing.GRID_BITS
_ENTROPY = "ln(sum(exp(x * ln(p)))) - sum(exp(x * ln(p)) * x * ln(p)) / sum(exp(x * ln(p)))"
# The exponent is searched on the same grid, in 1024 coarse and 1024 fine steps.
OP1_SQL = rf"""
WITH t AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, CAST(len(list_filter(
         regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens
  FROM documents),
tot AS (SELECT src, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n FROM t GROUP BY src),
pos AS (SELECT n, n / sum(n) OVER () AS p FROM tot WHERE n > 0),
lim AS (SELECT count(*) AS k, min(n) AS low, max(n) AS high FROM pos),
coarse AS (SELECT g, {_ENTROPY} AS h FROM (SELECT unnest(range(0, 1025)) AS g, g / 1024.0::DOUBLE AS x), pos GROUP BY g),
c AS (SELECT max(g) AS g FROM coarse, lim WHERE h >= {mixing.ENTROPY_SHARE} * ln(k) - {mixing.SLACK}),
fine AS (SELECT f, {_ENTROPY} AS h FROM (
    SELECT unnest(range(0, 1024)) AS f, (c.g * 1024 + f) / {_GRID}.0::DOUBLE AS x FROM c), pos GROUP BY f),
ent AS (SELECT least({_GRID}, (SELECT g FROM c) * 1024 + (SELECT max(f) FROM fine, lim
        WHERE h >= {mixing.ENTROPY_SHARE} * ln(k) - {mixing.SLACK} AND (SELECT g FROM c) < 1024 OR f = 0)) AS v),
rep AS (SELECT CASE WHEN high > low THEN greatest(0, ceil((1 - ln({mixing.MAX_REPEAT} + {mixing.SLACK})
               / ln(high / low::DOUBLE)) * {_GRID})) ELSE 0 END AS v FROM lim),
ex AS (SELECT CASE WHEN k <= 1 THEN 1.0 ELSE greatest(ent.v, rep.v) / {_GRID}.0::DOUBLE END AS x, high FROM lim, ent, rep),
want AS (SELECT src, n_docs, n, CASE WHEN n > 0 THEN greatest(CAST(floor(pow(n, x) * pow(high, 1 - x) + 1e-6) AS BIGINT), n)
                                     ELSE 0 END AS w FROM tot, ex),
share AS (SELECT src, n_docs, CASE WHEN n > 0 THEN w // n ELSE 1 END AS "full", CASE WHEN n > 0 THEN w % n ELSE 0 END AS rest FROM want),
dealt AS (SELECT t.*, s."full", s.rest, {_md5(str(mixing.SEED), 'doc_id')} % CAST(ceil(n_docs / {mixing.BLOCK_DOCS}) AS BIGINT) AS block
          FROM t JOIN share s USING (src)),
blocks AS (SELECT src, block, "full", rest, sum(n_tokens) AS size FROM dealt GROUP BY ALL),
cut AS (SELECT src, block, size, greatest(rest - coalesce(sum(size) OVER (PARTITION BY src ORDER BY
          {_md5(str(mixing.SEED), '"full"', 'src', 'block')}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room
        FROM blocks),
placed AS (SELECT d.*, size, room, sum(n_tokens) OVER (PARTITION BY d.src, d.block ORDER BY
             {_md5(str(mixing.SEED), '"full"', 'doc_id')}, doc_id) AS upto FROM dealt d JOIN cut USING (src, block)),
copied AS (SELECT *, "full" + CASE WHEN room BETWEEN 1 AND size - 1 THEN CAST(upto <= room AS INT)
                                   WHEN room >= size AND rest > 0 THEN 1 ELSE 0 END AS copies FROM placed),
read AS (SELECT doc_id, source, src, block, n_tokens, CAST(unnest(range(0, copies)) AS INT) AS epoch FROM copied)
SELECT doc_id, source, epoch, block, n_tokens, {_md5(str(mixing.SEED), 'epoch', 'src', 'block')} AS block_key,
       {_md5(str(mixing.SEED), 'epoch', 'doc_id')} AS doc_key FROM read"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL}
