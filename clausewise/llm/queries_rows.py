"""Row-wise queries: op7 (quality rules), op8 (personal data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, quality_rules
from .common import table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    led = quality_rules.ledger(quality_rules.measure(docs))
    return quality_rules.apply_policy(led).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_letters", "n_upper", "failure_bits")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The filter-free generator keeps the optimiser from copying the span array into each use.
    got = pii.detect(docs).select("doc_id", F.explode(F.array("spans")).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return got.select("doc_id", *[count(k) for k in pii.KINDS],
                      F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                      F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0)).alias("max_score"))


def queries() -> dict:
    return {"op7_quality_rules": op7_quality_rules, "op8_pii": op8_pii}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, p, list_slice(w, p, p + 4) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt
  FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - p, 5))) AS n FROM rep GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, CAST(
    1 * CAST(n_words < 10 AS INT)
  + 2 * CAST(100 * n_repeat_words > 20 * n_words AS INT)
  + 4 * CAST(word_chars < 2 * n_words OR word_chars > 20 * n_words AS INT)
  + 8 * CAST(10 * n_symbols > 3 * n_words AS INT)
  + 16 * CAST(10 * n_dup_lines > 4 * n_lines AND n_dup_lines > 2 AS INT)
  + 32 * CAST(2 * n_upper > n_letters AND n_letters > 0 AS INT)
  + 64 * CAST(2 * n_letters < word_chars AS INT) AS BIGINT) AS failure_bits FROM m)
SELECT *, (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept FROM b"""


# Fixed values, stated again: kind, pattern, score of a confirmed match, context words.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 60, "mail|contact|write"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 80, "ip|address|host|server"),
    ("card", r"[0-9]([\x20-]?[0-9])+", 80, "card|visa|credit|payment"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 60, "phone|tel|call|mobile|fax"),
    ("iban", None, 80, "iban|account|bank|konto"),
    # RE2 has no look-around: whole runs of digits and hyphens, of which those of the form stay
    ("ssn", r"[0-9-]+", 50, "ssn|social security|tax"),
)


def _op8_sql() -> str:
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN "
            f"CAST(substr(reverse({digits}), i, 1) AS INT) ELSE CAST(substr('0246813579', "
            f"CAST(substr(reverse({digits}), i, 1) AS INT) + 1, 1) AS INT) END)) % 10 = 0")
    code = "(substr(replace(x.m, ' ', ''), 5) || substr(replace(x.m, ' ', ''), 1, 4))"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 "
              "OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": f"(length({digits}) BETWEEN 16 AND 19 AND {luhn})",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": "list_reduce(list_prepend(0, list_transform(range(1, length(" + code + ") + 1), lambda i: ascii(substr(" + code
                + ", i, 1)))), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1",
        "ssn": "(regexp_full_match(x.m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(x.m, '^(000|666|9)') "
               "AND NOT regexp_matches(x.m, '-00-') AND NOT regexp_matches(x.m, '0000$'))",
    }
    parts, cols = [], []
    for k, pattern, base, words in _KINDS:
        pattern = pattern or pii.iban_pattern("?:")
        parts.append(f"""
{k}_a AS (SELECT rid, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM d),
{k}_s AS (SELECT rid, list_filter(list_transform(list_transform(range(1, len(m) + 1), lambda i: {{
    's': CAST(list_sum(list_transform(list_slice(p, 1, i), lambda z: length(z)))
         + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda z: length(z))), 0) AS INT), 'm': m[i]}}),
    lambda y: {{'s': y.s, 'm': y.m, 'score': {base} + CASE WHEN
      regexp_matches(lower(substr(text, greatest(y.s - 39, 1), least(y.s, 40))), '{words}') THEN 20 ELSE 0 END}}),
    lambda x: {valid[k]}{'' if k in ("email", "ip", "card", "phone") else ' AND x.score >= 60'}) AS v FROM {k}_a),
{k} AS (SELECT rid, list_transform(v, lambda x: '{k}:' || x.s || ':' || (x.s + length(x.m))) AS v,
        list_max(list_transform(v, lambda x: x.score)) AS top FROM {k}_s)""")
        cols.append(f"CAST(len({k}.v) AS BIGINT) AS n_{k}")
    kinds = [k for k, *_ in _KINDS]
    joins = " ".join(f"JOIN {k} USING (rid)" for k in kinds)
    cat = lambda ks: "array_to_string(" + " || ".join(f"{k}.v" for k in ks) + ", ',')"
    return (r"WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),"
            + ",".join(parts) + f"""
SELECT doc_id, {', '.join(cols)}, sha256({cat(kinds[:4])}) AS base_sha256, {cat(kinds)} AS spans,
       CAST(coalesce(greatest({', '.join(f'{k}.top' for k in kinds)}), 0) AS INT) AS max_score
FROM d {joins}""")


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": OP7_SQL, "op8_pii": _op8_sql()}
