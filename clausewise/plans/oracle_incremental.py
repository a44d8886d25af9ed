"""DuckDB SQL of the incremental stages: one build over the whole corpus, and ids dealt
part after part."""

from __future__ import annotations

from clausewise.plans.oracle import CELLS, _seq


def _terms() -> str:
    return f"""WITH {CELLS},
own AS (SELECT * FROM vocab WHERE persona = 'alice'),
sums AS (
  SELECT term, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * n) AS BIGINT) AS total_sq FROM cells WHERE persona = 'alice' GROUP BY term
),
ones AS (SELECT persona, term, CAST(sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS BIGINT) AS s1 FROM cells GROUP BY persona, term)
SELECT own.term, multiplicity, f.d AS first_doc_id, f.c AS first_clause_no, f.p AS first_pos, l.d AS last_doc_id, l.c AS last_clause_no,
       l.p AS last_pos, total, total_sq, (SELECT n_units FROM sizes WHERE persona = 'alice') AS n_units,
       a.s1 AS s1_label_alice, b.s1 AS s1_label_bob, c.s1 AS s1_label_charlie
FROM own JOIN sums USING (term) JOIN ones a ON a.persona = 'alice' AND a.term = own.term
JOIN ones b ON b.persona = 'bob' AND b.term = own.term JOIN ones c ON c.persona = 'charlie' AND c.term = own.term"""


def _dictionary() -> str:
    return f"""WITH {_seq(False)},
part AS (
  SELECT lower(word) AS term, CASE doc_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS v, count(*) AS freq FROM ltok
  WHERE lower(word) NOT IN ('[cls]', '[sep]') GROUP BY ALL
),
born AS (SELECT term, min(v) AS v FROM part GROUP BY term)
SELECT term, CAST(3 + row_number() OVER (ORDER BY v, freq DESC, term) AS INTEGER) AS id FROM born JOIN part USING (term, v)"""


def oracle_sql() -> dict[str, str]:
    return {"incremental_terms": _terms(), "incremental_dictionary": _dictionary()}
