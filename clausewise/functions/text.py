"""Column expressions for clause text: blank detection, segmentation, tokens.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
none of them crosses into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Python's str.isspace()/str.split() treat exactly these 29 code
# points as whitespace: \t \n \v \f \r, \x1c-\x1f, space, \x85, \xa0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000. Java's \s already
# covers [ \t\n\x0B\f\r]; the rest are listed. Kept as a raw string so that the
# \x and \u escapes reach Java's regex engine unchanged.
WS_CLASS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The tokeniser removes these substrings, in this order, before
# splitting on whitespace. Order matters ("e.g." loses its dots first and then
# vanishes as "eg").
STRIP_SEQUENCE = (".", ",", "eg", "(", ")")

BLANK_PATTERN = r"\A" + WS_CLASS + r"*\z"
WS_RUN = WS_CLASS + "+"


def is_blank(c: Column) -> Column:
    """True for '' and whitespace-only strings (Python ``isspace`` rules)."""
    return c.rlike(BLANK_PATTERN)


def clause_array(text: Column) -> Column:
    """Split a document on '\\n' and drop blank lines, keeping order.

    Narrow: runs inside the row, so clause numbering needs no window/shuffle.
    Surrounding spaces and a trailing '\\r' stay part of the clause.
    """
    return F.filter(F.split(text, "\n", -1), lambda x: ~is_blank(x))


def normalise_for_tokens(c: Column) -> Column:
    out = c
    for s in STRIP_SEQUENCE:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def token_array(clause: Column) -> Column:
    """Normalise, then split on runs of whitespace; no empty tokens."""
    return F.array_remove(F.split(normalise_for_tokens(clause), WS_RUN, -1), "")


def lower_token_array(clause: Column) -> Column:
    """Token array for the id-sequence path (dictionary is lower-cased)."""
    return token_array(F.lower(clause))
