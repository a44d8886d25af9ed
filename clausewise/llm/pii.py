"""Personal data: patterns propose spans, checksums confirm them, context words
move the score (DataFrame functions only, everything stays in the row).

A kind's matches come from ``regexp_extract_all`` and the text between them
from ``split`` with the same pattern; running sums of both lengths give code
point offsets. Patterns are written without backtracking into a run (possessive
loops, run starts by look-behind), so a very long token costs linear time.

Kinds: ``email``, ``ip`` (parts up to 255), ``card`` (16 to 19 digits, Luhn),
``phone`` (8 to 15 digits), which are always kept; ``iban`` (length by country,
mod 97) and ``ssn`` (issued ranges), which the score must carry over
``MIN_SCORE``. Score: 60 for the pattern (30 for ``ssn``), 20 more for a
checksum or range proof, 20 more for a context word in the 40 code points before
(other matches included, so one label serves a list).

Defined cases: null text is empty text and has no spans; an empty table gives
an empty table; repeated rows stay; extra columns pass through, but an input
column ``spans`` is replaced by ``detect``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# IBAN length by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def iban_pattern(group: str) -> str:
    """Country code, two check digits, the rest singly spaced at will."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    return "|".join(f"({group}{'|'.join(c)})[0-9]{{2}}({group} ?[A-Z0-9]){{{n - 4}}}"
                    for n, c in sorted(by_length.items(), reverse=True))


PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern("?:"),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
# A text without this cannot hold the kind; spares most texts the full pattern.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto", "ssn": "ssn|social security|tax",
}
CONTEXT_CHARS = 40
# Code points that a match has at least.
SHORTEST = {"email": 4, "ip": 7, "card": 2, "phone": 3, "iban": 15, "ssn": 11}
PROVEN = ("ip", "card", "iban", "ssn")
PATTERN_SCORE = {"ssn": 30}
MIN_SCORE = 60


def running_sums(values: Column, block: int = 64) -> Column:
    """Inclusive prefix sums of an array, in blocks, so that the growing
    accumulator arrays stay short and the cost near linear."""
    def short(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<int>"),
                           lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))

    def long(a: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / block).cast("int")),
                          lambda b: F.slice(a, b * block + 1, block))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
            return let(short(totals), lambda t: F.flatten(F.transform(
                blocks, lambda x, b: F.transform(short(x), lambda v: v + F.coalesce(F.get(t, b - 1), F.lit(0))))))

        return let(cut, joined)

    return let(values, lambda a: F.when(F.size(a) <= block, short(a)).otherwise(long(a)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _mod97(m: Column) -> Column:
    code = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        def small(p: Column) -> Column:
            bare = F.regexp_replace(p, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("0000$")
    return F.lit(True)


def _score(kind: str, before: Column) -> Column:
    base = PATTERN_SCORE.get(kind, 60) + (20 if kind in PROVEN else 0)
    return F.lit(base) + F.when(F.lower(before).rlike(CONTEXT[kind]), 20).otherwise(0)


def _contexts(kind: str, m: Column, pieces: Column, body) -> Column:
    """``body`` with a function from a match's number to the ``CONTEXT_CHARS`` code
    points before it: the end of its piece and, where that is shorter, of the
    matches and pieces before, of which so many reach far enough."""
    n = -(-CONTEXT_CHARS // SHORTEST[kind])
    end = lambda x: F.substring(x, -CONTEXT_CHARS, CONTEXT_CHARS)

    def before(ends: Column, i: Column) -> Column:
        first = F.greatest(i - n, F.lit(0))
        return F.when(F.length(F.get(ends, i)) >= CONTEXT_CHARS, end(F.get(ends, i))) \
            .otherwise(end(F.array_join(F.slice(ends, first + 1, i - first + 1), "")))

    # A match's end stands in front of the piece that follows it.
    ends = F.transform(pieces, lambda p, i: F.concat(F.coalesce(end(F.get(m, i - 1)), F.lit("")), end(p)))
    return let(ends, lambda e: body(lambda i: before(e, i)))


SPAN = "array<struct<kind:string,start:int,end:int,score:int>>"


def find(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, score) of one kind, by start; end exclusive."""
    pattern = PATTERNS[kind]

    def located(m: Column, pieces: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(F.get(pieces, i))
                            + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))
        spans = let(running_sums(steps), lambda s: _contexts(kind, m, pieces, lambda before: F.transform(
            m, lambda x, i: F.struct(
                F.lit(kind).alias("kind"), F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"),
                _score(kind, before(i)).alias("score"), x.alias("text")))))
        good = F.filter(spans, lambda x: _valid(kind, x["text"]) & (F.lit(kind in BASE) | (x["score"] >= MIN_SCORE)))
        return F.transform(good, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "score")]))

    none = F.array().cast(SPAN)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda p: located(m, p))))
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[A-Z]{2}[0-9]{2}" if kind == "iban" else "[0-9]")
    return F.when(hint, found).otherwise(none).cast(SPAN)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: all spans by kind in the order of ``KINDS``, then start."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn("spans", F.concat(*[find(t, k) for k in KINDS]))


def mask(text: Column, kinds: tuple[str, ...] = ("email", "iban", "card", "phone", "ip", "ssn")) -> Column:
    """``text`` with every confirmed span replaced by its kind, e.g. ``<EMAIL>``.
    Kinds are masked one after the other; null stays null."""
    for kind in kinds:
        text = _mask_kind(text, kind)
    return text


def _mask_kind(text: Column, kind: str) -> Column:
    pattern = PATTERNS[kind]

    def rebuilt(m: Column, pieces: Column) -> Column:
        def put(p: Column, i: Column, before) -> Column:
            x = F.get(m, i)
            sure = _valid(kind, x) & (F.lit(kind in BASE) | (_score(kind, before(i)) >= MIN_SCORE))
            return F.concat(p, F.when(x.isNull(), F.lit("")).when(sure, F.lit(f"<{kind.upper()}>")).otherwise(x))
        return _contexts(kind, m, pieces, lambda before: F.array_join(F.transform(pieces, lambda p, i: put(p, i, before)), ""))

    def one(t: Column) -> Column:
        hint = t.contains(HINTS[kind]) if kind in HINTS else t.rlike("[A-Z]{2}[0-9]{2}" if kind == "iban" else "[0-9]")
        return F.when(hint, let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.when(
            F.size(m) == 0, t).otherwise(let(F.split(t, pattern, -1), lambda p: rebuilt(m, p))))).otherwise(t)

    return let(text, one)


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with masked texts; columns and rows otherwise unchanged (a column
    ``n_chars`` follows the new text)."""
    out = docs.withColumn(text, mask(F.col(f"`{text}`")))
    return out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast("long")) if "n_chars" in docs.columns else out
