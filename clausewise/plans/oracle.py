"""DuckDB SQL that independently states what each registered query computes.

The driver runs these against the same parquet files (views named after the
tables). Counts and positions are cast to BIGINT, floats are compared after
the same rounding on both sides.
"""

from __future__ import annotations

from clausewise.functions.ratio import percent_sql

# The same 29 whitespace code points as WS_CLASS, in RE2 syntax
# (RE2's \s lacks \v, so \x{0b} is listed explicitly).
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

PERSONA_SQL = "(['alice','bob','charlie'])[doc_id % 3 + 1]"


def clause_list(text: str) -> str:
    return f"list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_full_match(x, '{WS}*'))"


def token_list(clause: str) -> str:
    norm = clause
    for s in (".", ",", "eg", "(", ")"):
        norm = f"replace({norm}, '{s}', '')"
    return f"list_filter(regexp_split_to_array({norm}, '{WS}+'), lambda w: w <> '')"


# clauses(doc_id, clause_no, clause) for every document
CLAUSES = f"""
clause_arrays AS (
  SELECT doc_id, {clause_list('text')} AS arr FROM documents
),
clauses AS (
  SELECT doc_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS clause_no, unnest(arr) AS clause
  FROM clause_arrays
)"""

# labelled(persona, doc_id, clause_no, clause, class)
LABELLED = f"""
labelled_docs AS (
  SELECT d.doc_id, l.quality, l.toxic, {clause_list('d.text')} AS arr
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
labelled_clauses AS (
  SELECT doc_id, quality, toxic, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS clause_no,
         unnest(arr) AS clause
  FROM labelled_docs
),
labelled AS (
  SELECT 'alice' AS persona, doc_id, clause_no, clause,
         CASE WHEN quality = 1 THEN 'worth_reading' ELSE 'standard_trivial' END AS class
  FROM labelled_clauses
  UNION ALL
  SELECT 'bob', doc_id, clause_no, clause,
         CASE WHEN toxic = 1 THEN 'worth_reading' ELSE 'standard_trivial' END
  FROM labelled_clauses
  UNION ALL
  SELECT 'charlie', doc_id, clause_no, clause,
         CASE WHEN quality = 1 AND toxic = 0 THEN 'worth_reading' ELSE 'standard_trivial' END
  FROM labelled_clauses
)"""


def ratio_cols(std: str = "standard_n", worth: str = "worth_n") -> str:
    n = f"({std} + {worth})"
    return (f"{percent_sql(std, n)} AS standard_ratio, "
            f"{percent_sql(worth, n)} AS worth_ratio")


def _persona_source_ratios() -> str:
    return f"""
WITH src_docs AS (
  SELECT d.doc_id, d.source, l.quality, l.toxic, {clause_list('d.text')} AS arr
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
c AS (SELECT source, quality, toxic, unnest(arr) AS clause FROM src_docs),
p AS (
  SELECT 'alice' AS persona, source, CASE WHEN quality = 1 THEN 'worth_reading' ELSE 'standard_trivial' END AS class FROM c
  UNION ALL
  SELECT 'bob', source, CASE WHEN toxic = 1 THEN 'worth_reading' ELSE 'standard_trivial' END FROM c
  UNION ALL
  SELECT 'charlie', source, CASE WHEN quality = 1 AND toxic = 0 THEN 'worth_reading' ELSE 'standard_trivial' END FROM c
),
g AS (
  SELECT persona, source,
         CAST(count(*) FILTER (WHERE class = 'standard_trivial') AS BIGINT) AS standard_n,
         CAST(count(*) FILTER (WHERE class = 'worth_reading') AS BIGINT) AS worth_n
  FROM p GROUP BY persona, source
)
SELECT persona, source, standard_n, worth_n, {ratio_cols()} FROM g
"""



def _segment_clauses() -> str:
    return f"WITH {CLAUSES} SELECT doc_id, clause_no, clause FROM clauses"


TOKENS = f"""
tok_arrays AS (SELECT doc_id, clause_no, {token_list('clause')} AS arr FROM clauses),
tokens AS (
  SELECT doc_id, clause_no, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS pos, unnest(arr) AS word
  FROM tok_arrays
)"""


def _tokenise_clauses() -> str:
    return f"WITH {CLAUSES}, {TOKENS} SELECT doc_id, clause_no, pos, word FROM tokens"


def _labelled_clauses() -> str:
    return f"WITH {LABELLED} SELECT persona, doc_id, clause_no, clause, class FROM labelled"


REQUESTS = f"""
whole_requests AS (
  SELECT doc_id AS request_id, doc_id % 50 AS slot, CAST(CASE doc_id % 50
           WHEN 17 THEN to_json({{'alertness': 'dave', 'title': source, 'text': text}})
           WHEN 22 THEN to_json({{'title': source, 'text': text}})
           WHEN 27 THEN to_json({{'alertness': {PERSONA_SQL}, 'title': source, 'text': ''}})
           WHEN 32 THEN to_json({{'alertness': {PERSONA_SQL}, 'title': source}})
           WHEN 37 THEN to_json({{'alertness': {PERSONA_SQL}, 'text': text}})
           WHEN 42 THEN to_json({{'alertness': {PERSONA_SQL}, 'title': source, 'text': ' ' || chr(10) || chr(9)}})
           ELSE to_json({{'alertness': {PERSONA_SQL}, 'title': source, 'text': text}}) END AS VARCHAR) AS body
  FROM documents
),
raw_requests AS (
  SELECT request_id, CASE slot WHEN 7 THEN left(body, length(body) - 1) WHEN 12 THEN body || ' and more'
                               ELSE body END AS body
  FROM whole_requests
),
sound AS (SELECT request_id, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS body
          FROM raw_requests),
parsed AS (
  SELECT request_id, ok,
         json_extract_string(body, '$.alertness') AS alertness,
         json_extract_string(body, '$.title') AS title,
         json_extract_string(body, '$.text') AS text
  FROM sound
),
checked AS (
  SELECT *, CASE WHEN NOT ok THEN 'invalid_json'
                 WHEN alertness IS NULL THEN 'missing_alertness'
                 WHEN alertness NOT IN ('alice', 'bob', 'charlie') THEN 'invalid_alertness'
                 WHEN text IS NULL THEN 'missing_text'
                 WHEN text = '' THEN 'empty_text'
                 WHEN title IS NULL THEN 'missing_title' END AS reason
  FROM parsed
)"""


def _parse_requests() -> str:
    return f"WITH {REQUESTS} SELECT request_id, alertness, title, text FROM checked WHERE reason IS NULL"


def _rejected_requests() -> str:
    return f"WITH {REQUESTS} SELECT request_id, reason FROM checked WHERE reason IS NOT NULL"


def _decode_case(mode: str, s0: str, s1: str | None) -> str:
    if mode == "bert":
        bad = f"({s0} IS NULL OR isnan({s0}))"
        lo, hi = f"{s0} < 0.5", f"{s0} > 0.5"
    else:
        a, b = (f"abs({s0})", f"abs({s1})") if mode == "tfm" else (s0, s1)
        bad = f"({s0} IS NULL OR isnan({s0}) OR {s1} IS NULL OR isnan({s1}))"
        lo, hi = f"{a} > {b}", f"{a} < {b}"
    cls = (f"CASE WHEN {bad} THEN NULL WHEN {lo} THEN 'standard_trivial' "
           f"WHEN {hi} THEN 'worth_reading' END")
    err = f"CASE WHEN {bad} THEN 'nan_score' WHEN NOT ({lo}) AND NOT ({hi}) THEN 'tie' END"
    return f"{cls} AS class, {err} AS decode_error"


EMB_SCORES = """
emb AS (
  SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS clause_no,
         CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2
  FROM embeddings
)"""


def _decode(mode: str) -> str:
    s0 = "((e1 + 1.0) / 2.0)" if mode == "bert" else "e1"
    return f"WITH {EMB_SCORES} SELECT doc_id, clause_no, {_decode_case(mode, s0, 'e2')} FROM emb"


def _decoded_all() -> str:
    parts = []
    for m in ("bow", "bert", "tfm"):
        s0 = "((e1 + 1.0) / 2.0)" if m == "bert" else "e1"
        parts.append(f"SELECT '{m}' AS mode, doc_id, clause_no, {_decode_case(m, s0, 'e2')} FROM emb")
    return f"WITH {EMB_SCORES}, decoded AS ({' UNION ALL '.join(parts)})"


def _doc_class_counts() -> str:
    return f"""{_decoded_all()}
SELECT mode, doc_id,
       CAST(count(*) FILTER (WHERE class = 'standard_trivial') AS BIGINT) AS standard_n,
       CAST(count(*) FILTER (WHERE class = 'worth_reading') AS BIGINT) AS worth_n
FROM decoded GROUP BY mode, doc_id"""


def _doc_ratios() -> str:
    return f"SELECT *, {ratio_cols()} FROM ({_doc_class_counts()})"


def _encode_first_seen() -> str:
    return f"""WITH {LABELLED},
firsts AS (
  SELECT persona, class, min(doc_id) AS d0
  FROM labelled GROUP BY persona, class
),
firsts2 AS (
  SELECT l.persona, l.class, min(l.clause_no) AS c0, f.d0
  FROM labelled l JOIN firsts f ON l.persona = f.persona AND l.class = f.class AND l.doc_id = f.d0
  GROUP BY l.persona, l.class, f.d0
),
ranked AS (
  SELECT persona, class, row_number() OVER (PARTITION BY persona ORDER BY d0, c0) - 1 AS rk FROM firsts2
)
SELECT l.persona, l.doc_id, l.clause_no, l.class,
       CAST(CASE WHEN r.rk <= 1 THEN r.rk END AS INTEGER) AS label,
       CASE WHEN r.rk > 1 THEN 'third_label' END AS encode_error
FROM labelled l LEFT JOIN ranked r ON l.persona = r.persona AND l.class = r.class"""


def _encode_fixed() -> str:
    return f"""WITH {LABELLED}
SELECT persona, doc_id, clause_no, CAST(CASE WHEN class = 'worth_reading' THEN 1 ELSE 0 END AS INTEGER) AS label
FROM labelled"""


def _one_hot() -> str:
    return f"""SELECT *, CASE WHEN label = 0 THEN [0, 1] WHEN label = 1 THEN [1, 0] END AS one_hot,
       CAST(CASE WHEN label = 0 THEN 1 WHEN label = 1 THEN 0 END AS INTEGER) AS argmax
FROM ({_encode_fixed()})"""


# request clauses classified by the stand-in model in tfm mode
CLASSIFIED = f"""
{REQUESTS},
req_arrays AS (
  SELECT request_id AS doc_id, alertness, title, {clause_list('text')} AS arr FROM checked WHERE reason IS NULL
),
req_clauses AS (
  SELECT doc_id, alertness, title, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS clause_no,
         unnest(arr) AS clause
  FROM req_arrays
),
req_scored AS (
  SELECT *, CAST(len(toks) AS DOUBLE) * 0.5 + 0.25 AS s0,
         CAST(len(list_filter(toks, lambda w: length(w) >= 7)) AS DOUBLE) AS s1
  FROM (SELECT *, {token_list('clause')} AS toks FROM req_clauses)
),
classified AS (
  SELECT doc_id, alertness, title, clause_no, clause, {_decode_case('tfm', 's0', 's1')}
  FROM req_scored
)"""


def _classified_clauses() -> str:
    return f"""WITH {CLASSIFIED}
SELECT doc_id, clause_no, clause, class, decode_error, 'tfm' AS mode, replace(title, ' ', '') AS title
FROM classified"""


def _marked_clauses() -> str:
    return f"""WITH {CLASSIFIED}
SELECT doc_id, clause_no, class,
       CASE WHEN class = 'worth_reading' THEN '***' || clause ELSE clause END AS marked_clause
FROM classified"""


REPORT = f"""
{CLASSIFIED},
report_counts AS (
  SELECT r.request_id AS doc_id, r.alertness, r.title,
         CAST(count(*) FILTER (WHERE class = 'standard_trivial') AS BIGINT) AS standard_n,
         CAST(count(*) FILTER (WHERE class = 'worth_reading') AS BIGINT) AS worth_n,
         CAST(count(*) FILTER (WHERE class IS NULL AND c.clause_no IS NOT NULL) AS BIGINT) AS error_n,
         coalesce(list_sort(list(clause_no) FILTER (WHERE class = 'worth_reading')), CAST([] AS BIGINT[]))
           AS worth_indices
  FROM checked r LEFT JOIN classified c ON c.doc_id = r.request_id
  WHERE r.reason IS NULL GROUP BY r.request_id, r.alertness, r.title
),
report AS (SELECT *, {ratio_cols()} FROM report_counts)"""


def _worth_indices() -> str:
    return f"WITH {REPORT} SELECT doc_id, worth_indices FROM report"


def _analyse_requests() -> str:
    return f"""WITH {REPORT}
SELECT doc_id, alertness, title, standard_n, worth_n, error_n, standard_ratio, worth_indices FROM report"""


def _annotated_documents() -> str:
    return f"""WITH {REPORT}
SELECT c.doc_id, r.standard_ratio, CAST(c.clause_no AS VARCHAR) AS clause_key,
       CASE WHEN c.class = 'worth_reading' THEN '***' || c.clause ELSE c.clause END AS clause
FROM classified c JOIN report r ON c.doc_id = r.doc_id"""



# labelled token arrays, distinct tokens with first-seen positions, vocabulary
LTA = f"""
{LABELLED},
lta AS (
  SELECT persona, doc_id, clause_no, class, CASE WHEN class = 'worth_reading' THEN 1 ELSE 0 END AS label,
         {token_list('clause')} AS toks
  FROM labelled
),
lt AS (
  SELECT persona, doc_id, clause_no, label, generate_subscripts(toks, 1) AS i, unnest(toks) AS word FROM lta
),
dt AS (
  SELECT persona, doc_id, clause_no, word AS term, min(i) AS i0 FROM lt GROUP BY persona, doc_id, clause_no, word
),
dtp AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY persona, doc_id, clause_no ORDER BY i0) - 1 AS BIGINT) AS dpos
  FROM dt
),
vocab AS (
  SELECT persona, term, CAST(count(*) AS BIGINT) AS multiplicity,
         min({{'d': doc_id, 'c': clause_no, 'p': dpos}}) AS f, max({{'d': doc_id, 'c': clause_no, 'p': dpos}}) AS l
  FROM dtp GROUP BY persona, term
),
sizes AS (
  SELECT persona, CAST(count(*) AS BIGINT) AS n_units,
         CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n0,
         CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n1
  FROM lta GROUP BY persona
)"""

# containment cells by the plain definition: contains(word, term)
CELLS = f"""
{LTA},
words AS (SELECT DISTINCT word FROM lt),
terms AS (SELECT DISTINCT term FROM vocab),
wt AS (SELECT w.word, t.term FROM words w JOIN terms t ON contains(w.word, t.term)),
pw AS (
  SELECT persona, doc_id, clause_no, label, word, count(*) AS k FROM lt GROUP BY persona, doc_id, clause_no, label, word
),
cells AS (
  SELECT pw.persona, pw.doc_id, pw.clause_no, pw.label, wt.term, CAST(sum(pw.k) AS BIGINT) AS n
  FROM pw JOIN wt ON pw.word = wt.word
          JOIN vocab v ON v.persona = pw.persona AND v.term = wt.term
  GROUP BY pw.persona, pw.doc_id, pw.clause_no, pw.label, wt.term
),
term_sums AS (
  SELECT persona, term, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * n) AS BIGINT) AS total_sq
  FROM cells GROUP BY persona, term
),
tstats AS (
  SELECT s.persona, s.term, s.total, s.total_sq, z.n_units,
         CAST(s.total AS DOUBLE) / CAST(z.n_units AS DOUBLE) AS mean,
         CASE WHEN CAST(z.n_units AS HUGEINT) * s.total_sq - CAST(s.total AS HUGEINT) * s.total = 0 THEN 1.0
              ELSE sqrt(CAST(CAST(z.n_units AS HUGEINT) * s.total_sq - CAST(s.total AS HUGEINT) * s.total AS DOUBLE))
                   / CAST(z.n_units AS DOUBLE) END AS std
  FROM term_sums s JOIN sizes z ON s.persona = z.persona
),
anova_sums AS (
  SELECT persona, term,
         CAST(sum(CASE WHEN label = 0 THEN n ELSE 0 END) AS BIGINT) AS s0,
         CAST(sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS BIGINT) AS s1,
         CAST(sum(n * n) AS BIGINT) AS q
  FROM cells GROUP BY persona, term
),
anova_dw AS (
  SELECT a.*, z.n0, z.n1,
         CAST(a.s0 AS HUGEINT) * z.n1 - CAST(a.s1 AS HUGEINT) * z.n0 AS d,
         CAST(a.q AS HUGEINT) * z.n0 * z.n1 - CAST(a.s0 AS HUGEINT) * a.s0 * z.n1
           - CAST(a.s1 AS HUGEINT) * a.s1 * z.n0 AS w
  FROM anova_sums a JOIN sizes z ON a.persona = z.persona
),
anova AS (
  SELECT persona, term, s0, s1, q,
         CASE WHEN n0 = 0 OR n1 = 0 THEN NULL
              WHEN w = 0 AND d = 0 THEN NULL
              WHEN w = 0 THEN CAST('inf' AS DOUBLE)
              ELSE (CAST(d AS DOUBLE) * CAST(d AS DOUBLE) * (CAST(n0 + n1 AS DOUBLE) - 2.0))
                   / (CAST(n0 + n1 AS DOUBLE) * CAST(w AS DOUBLE)) END AS f
  FROM anova_dw
)"""


def _vocabulary() -> str:
    return f"""WITH {LTA}
SELECT persona, term, multiplicity, f.d AS first_doc_id, f.c AS first_clause_no, f.p AS first_pos,
       l.d AS last_doc_id, l.c AS last_clause_no, l.p AS last_pos
FROM vocab"""


def _bow_exists() -> str:
    return f"""WITH {LTA}
SELECT dt.persona, dt.doc_id, dt.clause_no, dt.term, CAST(1 AS BIGINT) AS n
FROM dt WHERE EXISTS (SELECT 1 FROM vocab v WHERE v.persona = dt.persona AND v.term = dt.term)"""


def _bow_contains() -> str:
    return f"WITH {CELLS} SELECT persona, doc_id, clause_no, term, n FROM cells"


def _term_stats() -> str:
    return f"WITH {CELLS} SELECT *, -mean / std AS z0 FROM tstats"


def _standardise() -> str:
    return f"""WITH {CELLS}
SELECT c.persona, c.doc_id, c.clause_no, c.term, c.n, (CAST(c.n AS DOUBLE) - t.mean) / t.std AS z
FROM cells c JOIN tstats t ON c.persona = t.persona AND c.term = t.term"""


def _anova_f() -> str:
    return f"WITH {CELLS} SELECT persona, term, s0, s1, q, f FROM anova"


def _selection_ctes(k: int = 12000) -> str:
    return f"""
scored AS (
  SELECT v.persona, v.term, a.f, v.multiplicity, v.l.d AS ld, v.l.c AS lc, v.l.p AS lp
  FROM vocab v LEFT JOIN anova a ON a.persona = v.persona AND a.term = v.term
),
ranked AS (
  SELECT *, row_number() OVER w AS rk,
         sum(multiplicity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - multiplicity AS before
  FROM scored
  WINDOW w AS (PARTITION BY persona ORDER BY f DESC NULLS LAST, ld DESC, lc DESC, lp DESC, term DESC)
),
selected AS (
  SELECT persona, term, f, multiplicity,
         CAST(least(multiplicity, {k} - before) AS BIGINT) AS selected_multiplicity, CAST(rk AS BIGINT) AS rank
  FROM ranked WHERE rk <= {k} AND before < {k}
)"""


def _select_top_k(k: int = 12000) -> str:
    return f"WITH {CELLS}, {_selection_ctes(k)} SELECT * FROM selected"


def _document_features() -> str:
    return f"""WITH {CELLS}, {_selection_ctes()}, {REQUESTS.strip()},
doc_arrays AS (
  SELECT request_id AS doc_id, alertness AS persona, {clause_list('text')} AS arr FROM checked WHERE reason IS NULL
),
doc_clauses AS (
  SELECT doc_id, persona, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS clause_no, unnest(arr) AS clause
  FROM doc_arrays
),
doc_tokens AS (
  SELECT persona, doc_id, clause_no, unnest({token_list('clause')}) AS word FROM doc_clauses
),
doc_words AS (SELECT DISTINCT persona, word FROM doc_tokens),
doc_word_terms AS (
  SELECT w.persona, w.word, s.term FROM doc_words w JOIN selected s ON s.persona = w.persona AND contains(w.word, s.term)
),
doc_cells AS (
  SELECT t.persona, t.doc_id, t.clause_no, m.term, CAST(count(*) AS BIGINT) AS n
  FROM doc_tokens t JOIN doc_word_terms m ON t.persona = m.persona AND t.word = m.word
  GROUP BY t.persona, t.doc_id, t.clause_no, m.term
),
doc_sizes AS (SELECT persona, doc_id, CAST(count(*) AS BIGINT) AS n_units FROM doc_clauses GROUP BY persona, doc_id),
doc_sums AS (
  SELECT persona, doc_id, term, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * n) AS BIGINT) AS total_sq
  FROM doc_cells GROUP BY persona, doc_id, term
),
doc_stats AS (
  SELECT s.persona, s.doc_id, s.term, CAST(s.total AS DOUBLE) / CAST(z.n_units AS DOUBLE) AS mean,
         CASE WHEN CAST(z.n_units AS HUGEINT) * s.total_sq - CAST(s.total AS HUGEINT) * s.total = 0 THEN 1.0
              ELSE sqrt(CAST(CAST(z.n_units AS HUGEINT) * s.total_sq - CAST(s.total AS HUGEINT) * s.total AS DOUBLE))
                   / CAST(z.n_units AS DOUBLE) END AS std
  FROM doc_sums s JOIN doc_sizes z ON s.persona = z.persona AND s.doc_id = z.doc_id
)
SELECT c.persona, c.doc_id, c.clause_no, c.term, c.n, (CAST(c.n AS DOUBLE) - t.mean) / t.std AS z
FROM doc_cells c JOIN doc_stats t ON c.persona = t.persona AND c.doc_id = t.doc_id AND c.term = t.term"""



# labelled distinct clauses, their tokens and the corpus dictionary
def _seq(special: bool) -> str:
    src = "'[CLS] ' || clause || ' [SEP]'" if special else "clause"
    return f"""
ldocs AS (
  SELECT d.doc_id, {clause_list('d.text')} AS arr FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
ldc AS (
  SELECT doc_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS clause_no, unnest(arr) AS clause FROM ldocs
),
ltok AS (
  SELECT doc_id, clause_no, unnest(t) AS word FROM (SELECT doc_id, clause_no, {token_list('clause')} AS t FROM ldc)
),
wcounts AS (
  SELECT lower(word) AS term, count(*) AS freq FROM ltok WHERE lower(word) NOT IN ('[cls]', '[sep]') GROUP BY 1
),
dict AS (
  SELECT term, CAST(rn + 3 AS INTEGER) AS id
  FROM (SELECT term, row_number() OVER (ORDER BY freq DESC, term ASC) AS rn FROM wcounts)
),
ids_src AS (SELECT doc_id, clause_no, {token_list(src)} AS t FROM ldc),
ids_rows AS (
  SELECT doc_id, clause_no, generate_subscripts(t, 1) AS pos, unnest(t) AS word FROM ids_src
),
ids_agg AS (
  SELECT r.doc_id, r.clause_no,
         list(CAST(CASE WHEN r.word = '[CLS]' THEN 2 WHEN r.word = '[SEP]' THEN 3 ELSE coalesce(d.id, 1) END
                   AS INTEGER) ORDER BY r.pos) AS input_ids
  FROM ids_rows r LEFT JOIN dict d ON lower(r.word) = d.term
  GROUP BY r.doc_id, r.clause_no
),
ids AS (
  SELECT s.doc_id, s.clause_no, coalesce(a.input_ids, CAST([] AS INTEGER[])) AS input_ids
  FROM ids_src s LEFT JOIN ids_agg a ON s.doc_id = a.doc_id AND s.clause_no = a.clause_no
),
{LABELLED.strip()},
pids AS (
  SELECT l.persona, l.doc_id, l.clause_no, l.class, i.input_ids
  FROM labelled l JOIN ids i ON l.doc_id = i.doc_id AND l.clause_no = i.clause_no
),
maxlen AS (SELECT persona, CAST(max(len(input_ids)) AS BIGINT) AS max_length FROM pids GROUP BY persona)"""


def _zeros(n: str, value: int = 0) -> str:
    return f"CAST(list_transform(range(CAST(greatest({n}, 0) AS BIGINT)), lambda x: {value}) AS INTEGER[])"


def _special_tokens() -> str:
    return f"WITH {_seq(True)} SELECT doc_id, clause_no, '[CLS] ' || clause || ' [SEP]' AS clause FROM ldc"


def _encode_ids() -> str:
    return f"WITH {_seq(False)} SELECT doc_id, clause_no, input_ids FROM ids"


def _max_length_by_persona() -> str:
    return f"WITH {_seq(False)} SELECT persona, max_length FROM maxlen"


PADDED = """
padded AS (
  SELECT p.persona, p.doc_id, p.clause_no,
         list_concat(p.input_ids, {zeros}) AS input_ids
  FROM pids p JOIN maxlen m ON p.persona = m.persona
)"""


def _pad_ids() -> str:
    pad = PADDED.format(zeros=_zeros("m.max_length - len(p.input_ids)"))
    return f"WITH {_seq(False)}, {pad} SELECT persona, doc_id, clause_no, input_ids FROM padded"


def _shape_check() -> str:
    pad = PADDED.format(zeros=_zeros("m.max_length - len(p.input_ids)"))
    return f"""WITH {_seq(False)}, {pad}
SELECT persona, count(DISTINCT len(input_ids)) <= 1 AS equal_length, CAST(count(*) AS BIGINT) AS n_rows
FROM padded GROUP BY persona"""


def _model_input(max_len: int = 250) -> str:
    return f"""WITH {_seq(True)}
SELECT persona, doc_id, clause_no,
       list_concat(input_ids, {_zeros(f'{max_len} - len(input_ids)')}) AS input_ids,
       {_zeros(str(max_len))} AS token_type_ids,
       list_concat({_zeros('len(input_ids)', 1)}, {_zeros(f'{max_len} - len(input_ids)')}) AS attention_mask,
       [CAST(CASE WHEN class = 'worth_reading' THEN 1 ELSE 0 END AS INTEGER)] AS label
FROM pids"""



def _train_test_split() -> str:
    return f"""WITH {LABELLED},
ranked AS (
  SELECT persona, doc_id, clause_no,
         row_number() OVER (PARTITION BY persona ORDER BY md5(concat_ws(':', doc_id, clause_no, 42))) AS rk,
         count(*) OVER (PARTITION BY persona) AS n
  FROM labelled
)
SELECT persona, doc_id, clause_no,
       CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
FROM ranked"""


SMOTE_BASE = """
label_counts AS (SELECT label, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY label),
below AS (
  SELECT CAST(label AS BIGINT) AS label, n, (SELECT max(n) FROM label_counts) - n AS g FROM label_counts
  WHERE n < (SELECT max(n) FROM label_counts)
),
pts AS (
  SELECT b.label, b.n, b.g, e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS vec FROM embeddings e JOIN below b USING (label)
),
pairs AS (
  SELECT a.label, a.id, b.id AS nb_id, list_distance(a.vec, b.vec) AS dist
  FROM pts a JOIN pts b ON a.label = b.label AND a.id <> b.id
),
knn AS (
  SELECT label, id, nb_id, dist, CAST(nb_rank AS BIGINT) AS nb_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY dist, nb_id) AS nb_rank FROM pairs)
  WHERE nb_rank <= 5
)"""


def _smote_neighbours() -> str:
    return f"WITH {SMOTE_BASE} SELECT label, id, nb_id, dist, nb_rank FROM knn"


def _hash8(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


def _smote_samples() -> str:
    return f"""WITH {SMOTE_BASE},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', id, 42))) AS rk FROM pts WHERE n > 1
),
per_row AS (SELECT label, id, vec, n, (g // n) + CASE WHEN rk <= g % n THEN 1 ELSE 0 END AS m FROM ranked),
samples AS (
  SELECT label, id, vec, n, CAST(unnest(range(1, m + 1)) AS BIGINT) AS sample_no FROM per_row WHERE m > 0
),
picked AS (
  SELECT label, id, vec, sample_no,
         ({_hash8("concat_ws(':', id, sample_no, 'nb', 42)")} % least(5, n - 1)) + 1 AS nb_rank,
         CAST({_hash8("concat_ws(':', id, sample_no, 'lam', 42)")} AS DOUBLE) / 4294967296.0 AS lam
  FROM samples
)
SELECT p.label, p.id AS base_id, p.sample_no, k.nb_id, p.lam,
       list_transform(list_zip(p.vec, q.vec), lambda x: x[1] + p.lam * (x[2] - x[1])) AS vec
FROM picked p JOIN knn k ON p.label = k.label AND p.id = k.id AND p.nb_rank = k.nb_rank
              JOIN pts q ON q.label = k.label AND q.id = k.nb_id"""



EVAL = f"""
{CLASSIFIED},
held_out AS (
  SELECT alertness, doc_id, clause_no FROM (
    SELECT c.alertness, c.doc_id, c.clause_no, count(*) OVER (PARTITION BY alertness) AS n,
           row_number() OVER (PARTITION BY alertness ORDER BY md5(concat_ws(':', c.doc_id, c.clause_no, 42))) AS rk
    FROM req_clauses c JOIN labels l ON c.doc_id = l.doc_id)
  WHERE rk <= ceil(CAST(0.2 AS DOUBLE) * n)
),
eval_rows AS (
  SELECT c.alertness AS persona, c.doc_id, c.clause_no,
         CASE WHEN (c.alertness = 'alice' AND l.quality = 1) OR (c.alertness = 'bob' AND l.toxic = 1)
                   OR (c.alertness = 'charlie' AND l.quality = 1 AND l.toxic = 0) THEN 1 ELSE 0 END AS label,
         CASE WHEN c.class = 'worth_reading' THEN 1 ELSE 0 END AS prediction,
         CASE WHEN s.s0 - s.s1 > 700.0 THEN 0.0 ELSE 1.0 / (1.0 + exp(s.s0 - s.s1)) END AS p1
  FROM classified c
  JOIN req_scored s ON c.doc_id = s.doc_id AND c.clause_no = s.clause_no
  JOIN labels l ON c.doc_id = l.doc_id
  JOIN held_out h ON c.doc_id = h.doc_id AND c.clause_no = h.clause_no
  WHERE c.class IS NOT NULL
),
cm AS (
  SELECT persona,
         CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS c00,
         CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS c01,
         CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS c10,
         CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS c11
  FROM eval_rows GROUP BY persona
)"""


def _confusion_matrix() -> str:
    return f"WITH {EVAL} SELECT * FROM cm"


def _sens_spec() -> str:
    return f"""WITH {EVAL}
SELECT *, CASE WHEN c00 + c01 > 0 THEN CAST(c00 AS DOUBLE) / CAST(c00 + c01 AS DOUBLE) END AS sensitivity,
          CASE WHEN c11 + c10 > 0 THEN CAST(c11 AS DOUBLE) / CAST(c11 + c10 AS DOUBLE) END AS specificity
FROM cm"""


def _holdout_metrics() -> str:
    return f"""WITH {EVAL}
SELECT persona, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
       avg(-ln(CASE WHEN label = 1 THEN least(greatest(p1, 1e-7), 1.0 - 1e-7)
                    ELSE 1.0 - least(greatest(p1, 1e-7), 1.0 - 1e-7) END)) AS loss,
       CAST(count(*) AS BIGINT) AS n_rows
FROM eval_rows GROUP BY persona"""


def _doc_clauses() -> str:
    # the file holds text + '\n'; every line keeps its '\n' (the file ends with one)
    return f"""
WITH file_lines AS (
  SELECT doc_id, string_split(text || chr(10), chr(10)) AS parts FROM documents
),
kept AS (
  SELECT doc_id,
         list_filter(list_transform(parts[1:len(parts) - 1], lambda x: x || chr(10)),
                     lambda x: NOT regexp_full_match(x, '{WS}*')) AS arr
  FROM file_lines
)
SELECT doc_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS clause_no, unnest(arr) AS clause FROM kept"""


def _md5_weight(*parts: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 6)) AS BIGINT) % 201 - 100)"


def _margin_report(mode: str, s0: str, s1: str) -> str:
    """Per-request report from clause_margins(doc_id, clause_no, margin) and req_clauses."""
    return f"""
scored_clauses AS (
  SELECT c.doc_id, c.alertness, c.title, c.clause_no,
         CAST({_md5_weight("c.alertness", "'intercept'")} + coalesce(m.margin, 0) AS DOUBLE) AS m
  FROM req_clauses c LEFT JOIN clause_margins m ON m.doc_id = c.doc_id AND m.clause_no = c.clause_no
),
decoded_clauses AS (SELECT *, {_decode_case(mode, s0, s1)} FROM scored_clauses),
counted AS (
  SELECT r.request_id AS doc_id, r.alertness, r.title,
         CAST(count(*) FILTER (WHERE class = 'standard_trivial') AS BIGINT) AS standard_n,
         CAST(count(*) FILTER (WHERE class = 'worth_reading') AS BIGINT) AS worth_n,
         CAST(count(*) FILTER (WHERE class IS NULL AND c.clause_no IS NOT NULL) AS BIGINT) AS error_n,
         coalesce(list_sort(list(clause_no) FILTER (WHERE class = 'worth_reading')), CAST([] AS BIGINT[])) AS worth_indices
  FROM checked r LEFT JOIN decoded_clauses c ON c.doc_id = r.request_id
  WHERE r.reason IS NULL GROUP BY r.request_id, r.alertness, r.title
)
SELECT doc_id, alertness, title, standard_n, worth_n, error_n,
       {percent_sql('standard_n', '(standard_n + worth_n)')} AS standard_ratio, worth_indices FROM counted"""


def _analyse_requests_bow() -> str:
    return f"""WITH {CELLS}, {_selection_ctes()}, {CLASSIFIED.strip()},
req_words AS (
  SELECT alertness AS persona, doc_id, clause_no, unnest({token_list('clause')}) AS word FROM req_clauses
),
req_distinct AS (SELECT DISTINCT persona, word FROM req_words),
req_terms AS (
  SELECT w.persona, w.word, s.term FROM req_distinct w JOIN selected s ON s.persona = w.persona AND contains(w.word, s.term)
),
clause_margins AS (
  SELECT w.doc_id, w.clause_no, sum({_md5_weight("t.persona", "t.term")}) AS margin
  FROM req_words w JOIN req_terms t ON t.persona = w.persona AND t.word = w.word GROUP BY w.doc_id, w.clause_no
),
{_margin_report('bow', '-m', 'm')}"""


def _analyse_requests_sequence() -> str:
    grams = "list_transform(range(1, len(ids)), lambda i: ids[i] || ' ' || ids[i + 1])"
    return f"""WITH {_seq(False)}, {CLASSIFIED.strip()},
known AS (SELECT DISTINCT unnest({grams.replace('ids', 'input_ids')}) AS g FROM ids),
req_tokens AS (
  SELECT doc_id, alertness, clause_no, generate_subscripts(t, 1) AS pos, unnest(t) AS word
  FROM (SELECT doc_id, alertness, clause_no, {token_list('clause')} AS t FROM req_clauses)
),
req_ids AS (
  SELECT r.doc_id, r.alertness, r.clause_no,
         list(CASE WHEN r.word = '[CLS]' THEN 2 WHEN r.word = '[SEP]' THEN 3 ELSE coalesce(d.id, 1) END ORDER BY r.pos) AS ids
  FROM req_tokens r LEFT JOIN dict d ON lower(r.word) = d.term GROUP BY ALL
),
req_grams AS (SELECT doc_id, alertness, clause_no, unnest(list_distinct({grams})) AS g FROM req_ids),
clause_margins AS (
  SELECT r.doc_id, r.clause_no, sum({_md5_weight("r.alertness", "r.g")}) AS margin
  FROM req_grams r JOIN known k USING (g) GROUP BY r.doc_id, r.clause_no
),
{_margin_report('bert', '(1 / (1 + exp(least(greatest(-m, -700), 700))))', 'm')}"""


def _labelled_csv() -> str:
    return f"WITH {LABELLED} SELECT persona, clause, class FROM labelled"


def _bow_by_persona() -> str:
    return f"""WITH own AS (
  SELECT d.doc_id, {PERSONA_SQL.replace('doc_id', 'd.doc_id')} AS persona, {clause_list('d.text')} AS arr
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
c AS (SELECT persona, doc_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS clause_no, unnest(arr) AS clause FROM own),
w AS (SELECT persona, doc_id, clause_no, unnest({token_list('clause')}) AS word FROM c),
t AS (SELECT DISTINCT persona, word FROM w),
m AS (SELECT a.persona, a.word, b.word AS term FROM t a JOIN t b ON a.persona = b.persona AND contains(a.word, b.word))
SELECT w.persona, w.doc_id, w.clause_no, m.term, CAST(count(*) AS BIGINT) AS n
FROM w JOIN m ON w.persona = m.persona AND w.word = m.word GROUP BY ALL"""


def _best_run_table() -> str:
    return f"""WITH {EVAL},
runs AS (
  SELECT persona, label, prediction, reg_param,
         CASE WHEN p1 > 0 THEN 1 / (1 + exp(ln((1 - p1) / p1) * reg_param)) ELSE 0.0 END AS p1
  FROM eval_rows, (SELECT unnest([0.125, 0.25, 0.5, 1.0])::DOUBLE AS reg_param)
),
metrics AS (
  SELECT persona, reg_param,
         round(avg(-ln(CASE WHEN label = 1 THEN least(greatest(p1, 1e-7), 1.0 - 1e-7)
                            ELSE 1.0 - least(greatest(p1, 1e-7), 1.0 - 1e-7) END)), 9) AS loss
  FROM runs GROUP BY persona, reg_param
)
SELECT persona, arg_min(reg_param, {{'l': loss, 'r': reg_param}}) AS best_reg_param, min(loss) AS best_loss
FROM metrics GROUP BY persona"""


def oracle_sql() -> dict[str, str]:
    return {
        "labelled_csv": _labelled_csv(),
        "analyse_requests_bow": _analyse_requests_bow(),
        "analyse_requests_sequence": _analyse_requests_sequence(),
        "bow_by_persona": _bow_by_persona(),
        "best_run_table": _best_run_table(),
        "persona_source_ratios": _persona_source_ratios(),
        "segment_clauses": _segment_clauses(),
        "doc_clauses": _doc_clauses(),
        "tokenise_clauses": _tokenise_clauses(),
        "labelled_clauses": _labelled_clauses(),
        "parse_requests": _parse_requests(),
        "rejected_requests": _rejected_requests(),
        "decode_bow": _decode("bow"),
        "decode_bert": _decode("bert"),
        "decode_tfm": _decode("tfm"),
        "doc_class_counts": _doc_class_counts(),
        "doc_ratios": _doc_ratios(),
        "encode_first_seen": _encode_first_seen(),
        "encode_fixed": _encode_fixed(),
        "one_hot": _one_hot(),
        "classified_clauses": _classified_clauses(),
        "marked_clauses": _marked_clauses(),
        "worth_indices": _worth_indices(),
        "annotated_documents": _annotated_documents(),
        "analyse_requests": _analyse_requests(),
        "vocabulary": _vocabulary(),
        "bow_exists": _bow_exists(),
        "bow_contains": _bow_contains(),
        "term_stats": _term_stats(),
        "standardise": _standardise(),
        "anova_f": _anova_f(),
        "select_top_k": _select_top_k(),
        "document_features": _document_features(),
        "special_tokens": _special_tokens(),
        "encode_ids": _encode_ids(),
        "max_length_by_persona": _max_length_by_persona(),
        "pad_ids": _pad_ids(),
        "shape_check": _shape_check(),
        "model_input": _model_input(),
        "train_test_split": _train_test_split(),
        "smote_neighbours": _smote_neighbours(),
        "smote_samples": _smote_samples(),
        "confusion_matrix": _confusion_matrix(),
        "sens_spec": _sens_spec(),
        "holdout_metrics": _holdout_metrics(),
    }
