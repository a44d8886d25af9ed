"""DuckDB SQL of resampling on bag-of-words counts: all pairs, all synthetic rows and
all columns written out."""

from __future__ import annotations

from clausewise.plans.oracle import CELLS, LABELLED, _seq, token_list
from clausewise.plans.oracle_models import SPLIT

# training clauses, their cells, and the distances of all minority pairs
BASE = f"""
{LABELLED},
{SPLIT.strip()},
tr AS (SELECT persona, doc_id, clause_no, doc_id || ':' || clause_no AS id, y FROM u WHERE split = 'train'),
tk AS MATERIALIZED (SELECT doc_id, clause_no, doc_id || ':' || clause_no AS id, {token_list('clause')} AS toks FROM spl WHERE split = 'train'),
tw AS (SELECT id, doc_id, clause_no, generate_subscripts(toks, 1) AS i, unnest(toks) AS word FROM tk),
td AS (SELECT doc_id, clause_no, word AS term, min(i) AS i0 FROM tw GROUP BY ALL),
co AS (SELECT term, doc_id, clause_no, row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY i0) - 1 AS p FROM td),
voc AS (SELECT term, CAST(count(*) AS BIGINT) AS multiplicity FROM co GROUP BY term),
wt AS MATERIALIZED (SELECT w.word, t.term FROM (SELECT DISTINCT word FROM tw) w JOIN voc t ON contains(w.word, t.term)),
ce AS MATERIALIZED (
  SELECT id, term, CAST(count(*) AS BIGINT) AS n FROM tw JOIN wt USING (word) GROUP BY id, term
),
nu AS (SELECT CAST(count(*) AS HUGEINT) AS n FROM tk),
sm AS (SELECT term, CAST(sum(n) AS HUGEINT) AS s, CAST(sum(n * n) AS HUGEINT) AS q FROM ce GROUP BY term),
we AS MATERIALIZED (
  SELECT term, CASE WHEN nu.n * q - s * s = 0 THEN 65536 * multiplicity
                    ELSE (65536 * multiplicity * nu.n * nu.n) // (nu.n * q - s * s) END AS w
  FROM sm JOIN voc USING (term), nu
),
sz AS (
  SELECT persona, CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS n1 FROM tr GROUP BY persona
),
nd AS (SELECT *, CASE WHEN n0 < n1 THEN 0 ELSE 1 END AS minor, least(n0, n1) AS n, abs(n0 - n1) AS g FROM sz),
mi AS (SELECT tr.persona, tr.id, nd.n, nd.g FROM tr JOIN nd ON nd.persona = tr.persona AND nd.minor = tr.y WHERE nd.g > 0),
ids AS (SELECT DISTINCT id FROM mi),
mc AS MATERIALIZED (SELECT id, term, n, n * w AS wn FROM ce JOIN we USING (term) WHERE id IN (SELECT id FROM ids)),
nr AS (SELECT ids.id, CAST(coalesce(sum(n * wn), 0) AS BIGINT) AS norm2 FROM ids LEFT JOIN mc USING (id) GROUP BY ids.id),
dots AS MATERIALIZED (SELECT a.id, b.id AS nb_id, CAST(sum(a.n * b.wn) AS BIGINT) AS dot FROM mc a JOIN mc b USING (term) GROUP BY ALL),
pairs AS (
  SELECT a.persona, a.id, b.id AS nb_id, x.norm2 + y.norm2 - 2 * coalesce(d.dot, 0) AS dist2
  FROM mi a JOIN mi b ON a.persona = b.persona AND a.id <> b.id JOIN nr x ON x.id = a.id JOIN nr y ON y.id = b.id
  LEFT JOIN dots d ON d.id = a.id AND d.nb_id = b.id
),
knn AS MATERIALIZED (
  SELECT persona, id, nb_id, CAST(dist2 AS BIGINT) AS dist2, CAST(nb_rank AS BIGINT) AS nb_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY persona, id ORDER BY dist2, nb_id) AS nb_rank FROM pairs) WHERE nb_rank <= 5
)"""


def _hash8(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


SAMPLES = f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY md5(concat_ws(':', id, 42))) AS rk FROM mi WHERE n > 1),
sa AS (
  SELECT persona, id, n, CAST(unnest(range(1, (g // n) + CASE WHEN rk <= g % n THEN 1 ELSE 0 END + 1)) AS BIGINT) AS sample_no FROM rk
),
sg AS MATERIALIZED (
  SELECT s.persona, s.id AS base_id, s.sample_no, k.nb_id, s.h FROM (
    SELECT *, ({_hash8("concat_ws(':', id, sample_no, 'nb', 42)")} % least(5, n - 1)) + 1 AS nb_rank,
           {_hash8("concat_ws(':', id, sample_no, 'lam', 42)")} AS h FROM sa) s
  JOIN knn k ON k.persona = s.persona AND k.id = s.id AND k.nb_rank = s.nb_rank
),
sy AS MATERIALIZED (
  SELECT persona, base_id, sample_no, nb_id, term, CAST(sum(share * n) AS HUGEINT) AS v FROM (
    SELECT sg.*, ce.term, ce.n, 4294967296 - h AS share FROM sg JOIN ce ON ce.id = sg.base_id
    UNION ALL
    SELECT sg.*, ce.term, ce.n, h AS share FROM sg JOIN ce ON ce.id = sg.nb_id) GROUP BY ALL
)"""

AFTER = """
ob AS (
  SELECT persona, term, CAST(coalesce(sum(n) FILTER (WHERE y = 0), 0) AS HUGEINT) AS s0, CAST(coalesce(sum(n) FILTER (WHERE y = 1), 0) AS HUGEINT) AS s1,
         CAST(sum(n * n) AS HUGEINT) AS q FROM ce JOIN tr USING (id) GROUP BY persona, term
),
ma AS (SELECT persona, term, CAST(sum(v) AS HUGEINT) AS ms, CAST(sum(v * v) AS HUGEINT) AS mq FROM sy GROUP BY persona, term),
mo AS (
  SELECT ob.*, nd.n0, nd.n1, s0 * nd.n1 = s1 * nd.n0 AS same, q * nd.n0 * nd.n1 = s0 * s0 * nd.n1 + s1 * s1 * nd.n0 AS flat,
         CAST(s0 * 4294967296 + CASE WHEN minor = 0 THEN coalesce(ms, 0) ELSE 0 END AS DOUBLE) / 4294967296.0 AS e0,
         CAST(s1 * 4294967296 + CASE WHEN minor = 1 THEN coalesce(ms, 0) ELSE 0 END AS DOUBLE) / 4294967296.0 AS e1,
         CAST(q * 18446744073709551616::HUGEINT + coalesce(mq, 0) AS DOUBLE) / 18446744073709551616.0::DOUBLE AS eq,
         CAST(nd.n0 + CASE WHEN minor = 0 THEN g ELSE 0 END AS DOUBLE) AS m0, CAST(nd.n1 + CASE WHEN minor = 1 THEN g ELSE 0 END AS DOUBLE) AS m1
  FROM ob JOIN nd USING (persona) LEFT JOIN ma USING (persona, term)
),
dw AS (SELECT *, e0 * m1 - e1 * m0 AS d, eq * m0 * m1 - e0 * e0 * m1 - e1 * e1 * m0 AS w FROM mo),
fa AS MATERIALIZED (
  SELECT persona, term, CASE WHEN n0 = 0 OR n1 = 0 OR (flat AND same) THEN NULL WHEN flat THEN CAST('inf' AS DOUBLE)
         ELSE d * d * (m0 + m1 - 2.0) / ((m0 + m1) * w) END AS f FROM dw
)"""


def _neighbours() -> str:
    return f"WITH {BASE} SELECT * FROM knn"


def _samples() -> str:
    return f"""WITH {BASE}, {SAMPLES.strip()}
SELECT sg.persona, sg.base_id, sg.sample_no, sg.nb_id, CAST(sg.h AS DOUBLE) / 4294967296.0 AS lam,
       coalesce(list(term ORDER BY term) FILTER (WHERE v > 0), []) AS terms,
       coalesce(list(CAST(v AS DOUBLE) / 4294967296.0 ORDER BY term) FILTER (WHERE v > 0), []) AS "values"
FROM sg LEFT JOIN sy ON sy.persona = sg.persona AND sy.base_id = sg.base_id AND sy.sample_no = sg.sample_no GROUP BY ALL"""


def _anova() -> str:
    return f"WITH {BASE}, {SAMPLES.strip()}, {AFTER.strip()} SELECT * FROM fa"


def _by_column(scored: str, columns: str) -> str:
    return f"""
SELECT persona, term, any_value(f) AS f, any_value(multiplicity) AS multiplicity, CAST(count(*) AS BIGINT) AS selected_multiplicity
FROM (SELECT s.persona, s.term, s.f, s.multiplicity,
             row_number() OVER (PARTITION BY s.persona ORDER BY s.f DESC NULLS LAST, c.doc_id DESC, c.clause_no DESC, c.p DESC) AS rank
      FROM {scored} s JOIN {columns} c ON c.term = s.term) WHERE rank <= 12000 GROUP BY persona, term"""


def _select_after() -> str:
    return f"WITH {BASE}, {SAMPLES.strip()}, {AFTER.strip()}, sc AS (SELECT fa.*, multiplicity FROM fa JOIN voc USING (term)){_by_column('sc', 'co')}"


def _select_columns() -> str:
    return f"""WITH {CELLS},
sc AS (SELECT v.persona, v.term, a.f, v.multiplicity FROM vocab v JOIN anova a ON a.persona = v.persona AND a.term = v.term),
co AS (SELECT DISTINCT term, doc_id, clause_no, dpos AS p FROM dtp){_by_column('sc', 'co')}"""


def _sequences() -> str:
    """Padded id arrays: all pairs, position by position."""
    return f"""WITH {_seq(False)},
{SPLIT.strip()},
tr AS (SELECT persona, doc_id || ':' || clause_no AS id, y FROM u WHERE split = 'train'),
nd AS (
  SELECT persona, CASE WHEN n0 < n1 THEN 0 ELSE 1 END AS minor, least(n0, n1) AS n, abs(n0 - n1) AS g FROM (
    SELECT persona, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM tr GROUP BY persona)
),
ar AS MATERIALIZED (SELECT doc_id || ':' || clause_no AS id, input_ids AS v FROM ids),
mi AS (SELECT tr.persona, tr.id, nd.n, nd.g FROM tr JOIN nd ON nd.persona = tr.persona AND nd.minor = tr.y WHERE nd.g > 0),
mc AS MATERIALIZED (
  SELECT id, generate_subscripts(v, 1) AS pos, CAST(unnest(v) AS BIGINT) AS x FROM ar WHERE id IN (SELECT id FROM mi)
),
nr AS (SELECT i.id, coalesce(sum(x * x), 0) AS norm2 FROM (SELECT DISTINCT id FROM mi) i LEFT JOIN mc USING (id) GROUP BY i.id),
dots AS MATERIALIZED (SELECT a.id, b.id AS nb_id, sum(a.x * b.x) AS dot FROM mc a JOIN mc b USING (pos) GROUP BY ALL),
knn AS MATERIALIZED (
  SELECT persona, id, nb_id, nb_rank FROM (
    SELECT a.persona, a.id, b.id AS nb_id, row_number() OVER (
      PARTITION BY a.persona, a.id ORDER BY p.norm2 + q.norm2 - 2 * coalesce(d.dot, 0), b.id) AS nb_rank
    FROM mi a JOIN mi b ON a.persona = b.persona AND a.id <> b.id JOIN nr p ON p.id = a.id JOIN nr q ON q.id = b.id
    LEFT JOIN dots d ON d.id = a.id AND d.nb_id = b.id) WHERE nb_rank <= 5
),
{SAMPLES[:SAMPLES.index("sy AS MATERIALIZED")].strip().rstrip(",")}
SELECT sg.persona, sg.base_id, sg.sample_no, sg.nb_id,
       list_transform(range(1, greatest(len(a.v), len(b.v)) + 1), lambda i: CAST(
         (coalesce(a.v[i], 0)::BIGINT * (4294967296 - sg.h) + coalesce(b.v[i], 0)::BIGINT * sg.h) // 4294967296 AS INTEGER)) AS input_ids
FROM sg JOIN ar a ON a.id = sg.base_id JOIN ar b ON b.id = sg.nb_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "smote_bow_neighbours": _neighbours(),
        "smote_bow_samples": _samples(),
        "anova_after_smote": _anova(),
        "select_after_smote": _select_after(),
        "select_columns": _select_columns(),
        "smote_sequences": _sequences(),
    }
