"""DuckDB SQL of the fitted models: the same features, and the same fixed number of
full-batch steps written out step by step over plain tables."""

from __future__ import annotations

from clausewise.plans.oracle import (CLASSIFIED, LABELLED, _decode_case, _seq, percent_sql, token_list)

# Fixed values, stated again: steps, step width, penalties.
STEPS, RATE, L2_GRID = 6, 0.5, (0.0, 0.1)


def _models(penalties: tuple[float, ...]) -> str:
    rows = ", ".join(f"('{p}{i}', '{p}', CAST({x} AS DOUBLE))" for p in ("alice", "bob", "charlie") for i, x in enumerate(penalties))
    return f"mo AS (SELECT * FROM (VALUES {rows}) t(model, persona, l2))"


SPLIT = """
base AS (
  SELECT doc_id, clause_no, any_value(clause) AS clause FROM labelled GROUP BY doc_id, clause_no
),
spl AS (
  SELECT doc_id, clause_no, clause,
         CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', doc_id, clause_no, 42))) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ())
              THEN 'test' ELSE 'train' END AS split
  FROM base
),
u AS (
  SELECT l.persona, l.doc_id, l.clause_no, s.split, CASE WHEN l.class = 'worth_reading' THEN 1 ELSE 0 END AS y
  FROM labelled l JOIN spl s ON s.doc_id = l.doc_id AND s.clause_no = l.clause_no
)"""

# terms, cells, statistics and selection of the training clauses; cells of all clauses
BOW = f"""
{LABELLED},
{SPLIT.strip()},
tk AS MATERIALIZED (SELECT doc_id, clause_no, split, {token_list('clause')} AS toks FROM spl),
tw AS (SELECT doc_id, clause_no, split, generate_subscripts(toks, 1) AS i, unnest(toks) AS word FROM tk),
td AS (SELECT doc_id, clause_no, word AS term, min(i) AS i0 FROM tw WHERE split = 'train' GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY i0) AS dpos FROM td),
voc AS (
  SELECT term, CAST(count(*) AS BIGINT) AS multiplicity, max({{'d': doc_id, 'c': clause_no, 'p': dpos}}) AS l FROM tp GROUP BY term
),
wc AS (SELECT doc_id, clause_no, split, word, count(*) AS k FROM tw GROUP BY ALL),
wt AS MATERIALIZED (
  SELECT w.word, t.term FROM (SELECT DISTINCT word FROM tw) w JOIN voc t ON contains(w.word, t.term)
),
ce AS MATERIALIZED (
  SELECT doc_id, clause_no, split, term, CAST(sum(k) AS BIGINT) AS n FROM wc JOIN wt USING (word) GROUP BY ALL
),
sz AS (
  SELECT persona, count(*) AS nn, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1
  FROM u WHERE split = 'train' GROUP BY persona
),
su AS (
  SELECT u.persona, ce.term, CAST(sum(n) FILTER (WHERE y = 0) AS HUGEINT) AS s0, CAST(sum(n) FILTER (WHERE y = 1) AS HUGEINT) AS s1,
         CAST(sum(n * n) AS HUGEINT) AS q
  FROM ce JOIN u USING (doc_id, clause_no) WHERE ce.split = 'train' GROUP BY u.persona, ce.term
),
dw AS (
  SELECT persona, term, n0, n1, coalesce(s0, 0) * n1 - coalesce(s1, 0) * n0 AS d,
         q * n0 * n1 - coalesce(s0, 0) * coalesce(s0, 0) * n1 - coalesce(s1, 0) * coalesce(s1, 0) * n0 AS w
  FROM su JOIN sz USING (persona)
),
fv AS (
  SELECT persona, term, CASE WHEN n0 = 0 OR n1 = 0 OR (w = 0 AND d = 0) THEN NULL WHEN w = 0 THEN CAST('inf' AS DOUBLE)
         ELSE (CAST(d AS DOUBLE) * CAST(d AS DOUBLE) * (CAST(n0 + n1 AS DOUBLE) - 2.0)) / (CAST(n0 + n1 AS DOUBLE) * CAST(w AS DOUBLE)) END AS f
  FROM dw
),
rk AS (
  SELECT p.persona, voc.term, voc.multiplicity,
         sum(multiplicity) OVER (PARTITION BY p.persona ORDER BY f DESC NULLS LAST, l.d DESC, l.c DESC, l.p DESC, voc.term DESC
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - multiplicity AS before
  FROM voc CROSS JOIN (SELECT persona FROM sz) p LEFT JOIN fv ON fv.persona = p.persona AND fv.term = voc.term
),
se AS (SELECT persona, term, CAST(least(multiplicity, 12000 - before) AS BIGINT) AS k FROM rk WHERE before < 12000),
st AS (
  SELECT term, CAST(sum(n) AS HUGEINT) AS total, CAST(sum(n * n) AS HUGEINT) AS total_sq, (SELECT max(nn) FROM sz) AS nn
  FROM ce WHERE split = 'train' GROUP BY term
),
ft AS MATERIALIZED (
  SELECT se.persona, se.term AS f, k, CAST(total AS DOUBLE) / CAST(nn AS DOUBLE) AS mean,
         CASE WHEN nn * total_sq - total * total = 0 THEN 1.0 ELSE sqrt(CAST(nn * total_sq - total * total AS DOUBLE)) / CAST(nn AS DOUBLE) END AS std
  FROM se JOIN st USING (term)
),
cl AS MATERIALIZED (SELECT doc_id, clause_no, term AS f, n FROM ce)"""


def _seq_features() -> str:
    """Presence of the id n-grams of two to four; those of training clauses are features."""
    grams = " UNION ".join(
        f"SELECT doc_id, clause_no, unnest(list_transform(range(1, len(input_ids) - {w - 2}), "
        f"lambda i: array_to_string(list_slice(input_ids, i, i + {w - 1}), ' '))) AS f FROM ids" for w in (2, 3, 4))
    return f"""{_seq(False)},
{SPLIT.strip()},
cl AS MATERIALIZED (SELECT doc_id, clause_no, f, 1 AS n FROM ({grams})),
known AS (SELECT DISTINCT f FROM cl JOIN spl USING (doc_id, clause_no) WHERE split = 'train'),
ft AS MATERIALIZED (SELECT persona, f, 1 AS k, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS std FROM known, (SELECT DISTINCT persona FROM u))"""


def _descent(steps: int = STEPS) -> str:
    """w<e>(model, f, w, ..), b<e>(model, b) and ma<e>(model, .., y, split, m) for every epoch e."""
    parts = ["""
w0 AS (SELECT mo.model, mo.l2, ft.f, ft.k, ft.mean, ft.std, 0.0::DOUBLE AS w FROM ft JOIN mo USING (persona)),
b0 AS (SELECT model, 0.0::DOUBLE AS b FROM mo)"""]
    for e in range(steps + 1):
        parts.append(f"""
co{e} AS (SELECT b.model, b.b - coalesce(s.x, 0) AS c FROM b{e} b LEFT JOIN (
  SELECT model, sum(k * w / std * mean) AS x FROM w{e} GROUP BY model) s USING (model)),
ma{e} AS MATERIALIZED (
  SELECT mo.model, mo.persona, mo.l2, u.doc_id, u.clause_no, u.split, u.y, co{e}.c + coalesce(s.m, 0) AS m
  FROM u JOIN mo USING (persona) JOIN co{e} USING (model) LEFT JOIN (
    SELECT model, doc_id, clause_no, sum(n * (k * w / std)) AS m FROM cl JOIN w{e} USING (f) GROUP BY ALL) s
  ON s.model = mo.model AND s.doc_id = u.doc_id AND s.clause_no = u.clause_no)""")
        if e < steps:
            parts.append(f"""
re{e} AS MATERIALIZED (SELECT model, doc_id, clause_no, 1 / (1 + exp(least(greatest(-m, -700), 700))) - y AS r FROM ma{e} WHERE split = 'train'),
to{e} AS (SELECT model, count(*) AS n, sum(r) AS r FROM re{e} GROUP BY model),
gr{e} AS (SELECT model, f, sum(n * r) AS g FROM cl JOIN re{e} USING (doc_id, clause_no) GROUP BY ALL),
w{e + 1} AS MATERIALIZED (
  SELECT w.model, w.l2, w.f, w.k, w.mean, w.std,
         w.w - {RATE} * ((coalesce(g.g, 0) - w.mean * t.r) / w.std / t.n + w.l2 * w.w) AS w
  FROM w{e} w JOIN to{e} t USING (model) LEFT JOIN gr{e} g USING (model, f)),
b{e + 1} AS (SELECT model, b - {RATE} * (r / n) AS b FROM b{e} JOIN to{e} USING (model))""")
    return ",".join(parts)


_P = "1 / (1 + exp(least(greatest(-round(m, 9), -700), 700)))"


def _held_out(mode: str, score: str, a: str, b: str) -> str:
    return f"""
SELECT persona, doc_id, clause_no, y AS label, CAST(p > 0.5 AS INT) AS prediction, {score} AS score,
       class FROM (SELECT *, {_decode_case(mode, a, b)} FROM (SELECT *, {_P} AS p FROM ma{STEPS} WHERE split = 'test'))"""


def _score_bow() -> str:
    return f"WITH {BOW}, {_models((0.0,))}, {_descent()}{_held_out('bow', '[round(1 - p, 6), round(p, 6)]', '(1 - p)', 'p')}"


def _score_sequence() -> str:
    return f"WITH {_seq_features()}, {_models((0.0,))}, {_descent()}{_held_out('bert', '[round(p, 6)]', 'p', 'p')}"


def _metrics() -> str:
    per = " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM ma{e}" for e in range(STEPS + 1))
    clipped = "least(greatest(p, 1e-7), 1.0 - 1e-7)"
    return f"""
ev AS (SELECT *, {_P} AS p FROM ({per})),
me AS (
  SELECT persona, l2, epoch, split, count(*) AS n_rows, avg(-ln(CASE WHEN y = 1 THEN {clipped} ELSE 1 - {clipped} END)) AS loss,
         avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
         count(*) FILTER (WHERE y = 1 AND p > 0.5) AS c00, count(*) FILTER (WHERE y = 1 AND NOT p > 0.5) AS c01,
         count(*) FILTER (WHERE y = 0 AND p > 0.5) AS c10, count(*) FILTER (WHERE y = 0 AND NOT p > 0.5) AS c11
  FROM ev GROUP BY persona, l2, epoch, split)"""


def _training_metrics() -> str:
    return f"WITH {_seq_features()}, {_models(L2_GRID)}, {_descent()}, {_metrics()} SELECT * FROM me"


def _best_run() -> str:
    return f"""WITH {BOW}, {_models(L2_GRID)}, {_descent()}, {_metrics()}
SELECT persona, l2 AS best_reg_param, epoch AS best_epoch, loss AS best_loss FROM me WHERE split = 'test'
QUALIFY row_number() OVER (PARTITION BY persona ORDER BY round(loss, 9), l2, epoch) = 1"""


def _fitted_report(margins: str) -> str:
    return f"""
rq_words AS (SELECT alertness AS persona, doc_id, clause_no, unnest({token_list('clause')}) AS word FROM req_clauses),
rq_terms AS (
  SELECT w.persona, w.word, t.f FROM (SELECT DISTINCT persona, word FROM rq_words) w
  JOIN ft t ON t.persona = w.persona AND contains(w.word, t.f)),
rq_cells AS MATERIALIZED (
  SELECT persona, doc_id, clause_no, f, count(*) AS n FROM rq_words JOIN rq_terms USING (persona, word) GROUP BY ALL),
fw AS (SELECT mo.persona, w.f, w.k * w.w AS w, w.mean, w.std FROM w{STEPS} w JOIN mo USING (model)),
fb AS (SELECT mo.persona, b.b FROM b{STEPS} b JOIN mo USING (model)),
{margins},
sc AS (SELECT c.doc_id, c.alertness, c.title, c.clause_no, round(m.m, 9) AS m FROM req_clauses c
       JOIN clause_m m ON m.doc_id = c.doc_id AND m.clause_no = c.clause_no),
de AS (SELECT *, {_decode_case('bow', '(-m)', 'm')} FROM sc),
counted AS (
  SELECT r.request_id AS doc_id, r.alertness, r.title,
         count(*) FILTER (WHERE class = 'standard_trivial') AS standard_n, count(*) FILTER (WHERE class = 'worth_reading') AS worth_n,
         count(*) FILTER (WHERE class IS NULL AND c.clause_no IS NOT NULL) AS error_n,
         coalesce(list_sort(list(clause_no) FILTER (WHERE class = 'worth_reading')), CAST([] AS BIGINT[])) AS worth_indices
  FROM checked r LEFT JOIN de c ON c.doc_id = r.request_id WHERE r.reason IS NULL GROUP BY r.request_id, r.alertness, r.title
)
SELECT doc_id, alertness, title, standard_n, worth_n, error_n,
       {percent_sql('standard_n', '(standard_n + worth_n)')} AS standard_ratio, worth_indices FROM counted"""


def _analyse_requests_fitted() -> str:
    margins = """
clause_m AS (
  SELECT c.doc_id, c.clause_no, fb.b + coalesce(s.x, 0) + coalesce(k.x, 0) AS m
  FROM req_clauses c JOIN fb ON fb.persona = c.alertness
  LEFT JOIN (SELECT persona, -sum(w / std * mean) AS x FROM fw GROUP BY persona) k ON k.persona = c.alertness
  LEFT JOIN (SELECT doc_id, clause_no, sum(n * (w / std)) AS x FROM rq_cells JOIN fw USING (persona, f) GROUP BY ALL) s
         ON s.doc_id = c.doc_id AND s.clause_no = c.clause_no)"""
    return f"WITH {BOW}, {_models((0.0,))}, {_descent()}, {CLASSIFIED.strip()}, {_fitted_report(margins)}"


def _analyse_requests_refit() -> str:
    # dense by document: every term of the document in every clause, zeros written out
    margins = """
dn AS (SELECT doc_id, count(*) AS nn FROM req_clauses GROUP BY doc_id),
ds AS (
  SELECT persona, doc_id, f, CAST(sum(n) AS HUGEINT) AS total, CAST(sum(n * n) AS HUGEINT) AS total_sq FROM rq_cells GROUP BY ALL),
dz AS (
  SELECT persona, doc_id, f, CAST(total AS DOUBLE) / CAST(nn AS DOUBLE) AS mean,
         CASE WHEN nn * total_sq - total * total = 0 THEN 1.0
              ELSE sqrt(CAST(nn * total_sq - total * total AS DOUBLE)) / CAST(nn AS DOUBLE) END AS std
  FROM ds JOIN dn USING (doc_id)),
zs AS (
  SELECT c.doc_id, c.clause_no, sum(fw.w * (coalesce(x.n, 0) - dz.mean) / dz.std) AS x
  FROM req_clauses c JOIN dz ON dz.doc_id = c.doc_id JOIN fw ON fw.persona = dz.persona AND fw.f = dz.f
  LEFT JOIN rq_cells x ON x.doc_id = c.doc_id AND x.clause_no = c.clause_no AND x.f = dz.f GROUP BY ALL),
clause_m AS (
  SELECT c.doc_id, c.clause_no, fb.b + coalesce(zs.x, 0) AS m FROM req_clauses c JOIN fb ON fb.persona = c.alertness
  LEFT JOIN zs ON zs.doc_id = c.doc_id AND zs.clause_no = c.clause_no)"""
    return f"WITH {BOW}, {_models((0.0,))}, {_descent()}, {CLASSIFIED.strip()}, {_fitted_report(margins)}"


def _score_external() -> str:
    return f"WITH {CLASSIFIED} SELECT doc_id, clause_no, [s0, s1] AS score, class, decode_error FROM (" \
           f"SELECT c.*, r.s0, r.s1 FROM classified c JOIN req_scored r USING (doc_id, clause_no))"


def oracle_sql() -> dict[str, str]:
    return {
        "score_bow": _score_bow(),
        "score_sequence": _score_sequence(),
        "training_metrics": _training_metrics(),
        "best_run": _best_run(),
        "analyse_requests_fitted": _analyse_requests_fitted(),
        "analyse_requests_refit": _analyse_requests_refit(),
        "score_external": _score_external(),
    }
