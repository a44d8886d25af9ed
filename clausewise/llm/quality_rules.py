"""Quality rules as a bitmask ledger (DataFrame functions only).

``measure`` evaluates every measurement once per document, in the row (no
shuffle); ``ledger`` turns them into one bit per failed rule; ``apply_policy``
reads a versioned policy as a mask over those bits; ``ablations`` derives what
each rule rejects, alone and together, from the ledger by bitwise aggregation,
without reading a text again.

Defined cases: a null text counts as a text without words (it fails
``few_words``); repeated rows stay repeated rows; extra columns pass through
unless they carry the name of a measurement, which then wins; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, fresh, let

SPACE = r"[\x20\x09-\x0D]+"

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# name -> failing condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_windows": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines and n_dup_lines > 2",
    "shouting": "2 * n_upper > n_letters and n_letters > 0",
    "few_letters": "2 * n_letters < word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in dict.fromkeys(names))


# Versions are never edited; a change of mind is a new version.
POLICIES: dict[str, int] = {
    "v1": mask("few_words", "repeated_windows"),
    "v2": mask("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines", "shouting",
               "few_letters"),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
            "n_upper")


def _count_of(text: Column, other_than: str) -> Column:
    """Code points left after runs of ``other_than`` are removed."""
    return F.length(F.regexp_replace(text, other_than, "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more in the array ``words``.

    Windows are compared by 64-bit hash. Only arrays with a repeated window pay
    for the sort: positions of equal neighbours in hash order, then the length
    of the union of [p, p+5).
    """
    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))

    def repeated(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda v, j: F.least(F.lit(SHINGLE), F.coalesce(F.get(p, j + 1) - v, F.lit(SHINGLE))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(by_hash, lambda s: let(repeated(s), covered)))

    return let(words, lambda w: let(windows(w), count))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one long column per entry of ``MEASURES``."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    new = F.struct(
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        _count_of(t, r"[^#*$%&|<>]+").alias("n_symbols"),
        _count_of(t, r"[^\p{L}]+").alias("n_letters"),
        _count_of(t, r"[^\p{Lu}]+").alias("n_upper"))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    held, = fresh(docs.columns, "_m")
    where = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    got = docs.withColumn(held, new)
    return got.select(*keep, *[F.col(f"{held}.{where[m]}.{m}" if m in where else f"{held}.{m}").alias(m) for m in MEASURES])


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failure_bits``: bit i is set if rule i fails. Every rule is
    evaluated once; nothing later looks at a measurement again."""
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0).cast("long") for name, rule in RULES.items()),
               F.lit(0).cast("long"))
    return measured.withColumn("failure_bits", bits)


def apply_policy(led: DataFrame, version: str = CURRENT, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy version."""
    if version not in policies:
        raise ValueError(f"unknown policy version {version!r}")
    failed = F.col("failure_bits").bitwiseAND(F.lit(mask("few_words", "repeated_windows"))) != 0
    rejected = F.col("failure_bits").bitwiseAND(F.lit(policies[version])) != 0
    return led.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected)


def ablations(led: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """Per policy version and rule: documents the rule fails, documents the
    policy rejects, documents only this rule rejects (they return if it is
    dropped), and the OR of the bits that fail beside it. One aggregation to at
    most 2^rules rows, then arithmetic on those."""
    by_bits = led.groupBy("failure_bits").agg(F.count("*").alias("n"))
    grid = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"),
                              F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"))
                     for v, m in policies.items() for r, b in BIT.items() if m & b])
    g = by_bits.select("failure_bits", "n", F.inline(grid))
    active = F.col("failure_bits").bitwiseAND(F.col("mask"))
    fails = active.bitwiseAND(F.col("bit")) != 0
    return g.groupBy("version", "rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_fails"),
        F.sum(F.when(active != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(active == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.coalesce(F.bit_or(F.when(fails, active)), F.lit(0).cast("long")).alias("together_bits"))


def filter_documents(docs: DataFrame, text: str = "text", version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` the policy keeps, with their own columns only."""
    cols = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    kept = apply_policy(ledger(measure(held, "_text")), version).where("kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in cols])
