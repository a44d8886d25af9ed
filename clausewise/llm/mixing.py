"""Mixing sources to target weights by temperature.

With token shares p_s the weight of a source is p_s^x / sum p^x. The exponent x
in [0, 1] is bisected on a grid of 2^20 steps: the largest x whose weights keep
at least ``entropy_share`` of the maximal entropy ln(#sources), but not below
the smallest x at which no source is read more than ``max_repeat`` times. Four
bisection steps run in one pass over the table of sources (15 midpoints), so
that table, however long, never reaches the driver.

Without an explicit budget the budget is the smallest one that reads every
source at least once, so that no document is lost; the budget of a source is
then n_s^x * n_max^(1-x) tokens. With a budget in tokens it is the source's
share of it.

Budgets are realised in epochs. Documents of a source belong to blocks by a
hash; each epoch permutes the blocks by another hash and reads them in that
order. Whole epochs read everything; the last one stops at the budget: whole
blocks first, then, in the block where the budget ends, documents by a hash as
long as they fit. Only that block is ranked by document, so no task sorts a
source.

Defined cases: a null source is a source, a null id an id; null texts have no tokens; a source
without tokens has no weight and is read once; repeated rows share the fate of
their id; an empty table gives an empty plan; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

ENTROPY_SHARE = 0.95
MAX_REPEAT = 4.0
BLOCK_DOCS = 4096
SEED = 17
GRID_BITS = 20
SLACK = 1e-9  # comparisons allow for the order of floating-point sums


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def hashed(*parts) -> Column:
    """60-bit number from the MD5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_totals(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n"))


def fit_exponent(totals: DataFrame, entropy_share: float | None = ENTROPY_SHARE,
                 max_repeat: float | None = MAX_REPEAT, budget: int | None = None) -> float:
    """The exponent, from ``totals`` (src, n_docs, n). Only 15 rows of sums a
    pass reach the driver."""
    pos = totals.where("n > 0")
    whole = pos.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("low"),
                    F.max("n").alias("high")).first()
    if not whole["k"] or whole["k"] == 1:
        return 1.0
    logs = pos.select(F.log(F.col("n") / F.lit(float(whole["n"]))).alias("lp"))

    def curves(xs: list[float]) -> dict[float, tuple[float, float]]:
        """Entropy and normaliser at each exponent, in one pass."""
        grid = F.explode(F.array(*[F.lit(x) for x in xs]))
        w = F.exp(F.col("x") * F.col("lp"))
        rows = logs.withColumn("x", grid).groupBy("x").agg(
            F.sum(w).alias("z"), F.sum(w * F.col("x") * F.col("lp")).alias("s")).collect()
        return {r["x"]: (math.log(r["z"]) - r["s"] / r["z"], r["z"]) for r in rows}

    target = None if entropy_share is None else entropy_share * math.log(whole["k"])
    low_p, high_p = whole["low"] / whole["n"], whole["high"] / whole["n"]

    def repeats(x: float, z: float) -> float:
        if budget is None:
            return (high_p / low_p) ** (1 - x)
        return low_p ** (x - 1) / z * budget / whole["n"]

    def bisect(holds, want_largest: bool) -> int:
        """Largest (smallest) grid point at which ``holds``; it is true below (above) that point."""
        lo, hi = 0, 1 << GRID_BITS
        while hi - lo > 0:
            step = max(1, (hi - lo) >> 4)
            mids = sorted({min(hi, max(lo, lo + i * step)) for i in range(1, 16)} | {lo, hi})
            at = curves([m / (1 << GRID_BITS) for m in mids])
            ok = [m for m in mids if holds(m / (1 << GRID_BITS), *at[m / (1 << GRID_BITS)])]
            if not ok:
                return 0 if want_largest else 1 << GRID_BITS
            edge = max(ok) if want_largest else min(ok)
            beyond = [m for m in mids if (m > edge if want_largest else m < edge)]
            if not beyond:
                return edge
            near = min(beyond) if want_largest else max(beyond)
            if abs(near - edge) <= 1:
                return edge
            lo, hi = min(edge, near), max(edge, near)
        return lo

    x = 1 << GRID_BITS
    if target is not None:
        x = bisect(lambda _, h, z: h >= target - SLACK, True)
    elif max_repeat is not None:
        x = 0
    if max_repeat is not None:
        x = max(x, bisect(lambda a, h, z: repeats(a, z) <= max_repeat + SLACK, False))
    return x / (1 << GRID_BITS)


def budgets(totals: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """(src, n_docs, n, full, rest): whole epochs and tokens of the last one."""
    high = totals.agg(F.max("n")).first()[0] or 0
    n = F.col("n").cast("double")
    if budget is None:
        want = F.floor(F.pow(n, F.lit(exponent)) * F.pow(F.lit(float(high)), F.lit(1 - exponent)) + F.lit(1e-6))
        want = F.greatest(want, F.col("n"))
    else:
        z = totals.where("n > 0").agg(F.sum(F.pow(n, F.lit(exponent)))).first()[0] or 1.0
        want = F.floor(F.pow(n, F.lit(exponent)) / F.lit(z) * F.lit(float(budget)) + F.lit(1e-6))
    some = F.col("n") > 0
    return totals.withColumn("want", F.when(some, want).otherwise(0).cast("long")).select(
        "src", "n_docs", "n",
        F.when(some, F.floor(F.col("want") / F.col("n"))).otherwise(1).cast("int").alias("full"),
        F.when(some, F.col("want") % F.col("n")).otherwise(0).alias("rest"))


def plan(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id",
         entropy_share: float | None = ENTROPY_SHARE, max_repeat: float | None = MAX_REPEAT,
         budget: int | None = None, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_tokens, block, full (whole
    epochs that read it) and copies (with the last, partial epoch)."""
    from pyspark.sql import Window

    src = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("n"))
    tokens = stored(docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                                src.alias("src"), word_count(F.col(f"`{text}`")).alias("n_tokens")), "mix-tokens")
    totals = stored(source_totals(tokens), "mix-sources")
    x = fit_exponent(totals, entropy_share, max_repeat, budget)
    shares = stored(budgets(totals, x, budget), "mix-budgets")
    n_blocks = F.ceil(F.col("n_docs") / block_docs).cast("long")
    dealt = tokens.join(shares, "src").withColumn("block", hashed(F.lit(seed), "doc_id") % n_blocks)

    order = hashed(F.lit(seed), "full", "src", "block")
    blocks = dealt.groupBy("src", "block", "full", "rest").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy("src").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    cut = stored(blocks.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).select(
        "src", "block", F.greatest(F.col("rest") - F.col("before"), F.lit(0)).alias("room"), "size"), "mix-blocks")
    placed = dealt.join(cut, ["src", "block"])
    # Only the blocks in which a budget ends are ranked by document.
    edge = F.col("room").between(1, F.col("size") - 1)
    within = Window.partitionBy("src", "block").orderBy(hashed(F.lit(seed), "full", "doc_id"), "doc_id")
    ranked = placed.where(edge).withColumn("upto", F.sum("n_tokens").over(within)) \
        .withColumn("last", F.col("upto") <= F.col("room")).drop("upto")
    others = placed.where(~edge).withColumn("last", (F.col("room") >= F.col("size")) & (F.col("rest") > 0))
    return others.unionByName(ranked).select(
        "doc_id", "source", "n_tokens", "block", "full", (F.col("full") + F.col("last").cast("int")).alias("copies"))


def sample(planned: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per reading: (doc_id, source, epoch, block, n_tokens, block_key,
    doc_key). Within a source, an epoch's order is (block_key, doc_key)."""
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    r = planned.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return r.select("doc_id", "source", "epoch", "block", "n_tokens",
                    hashed(F.lit(seed), "epoch", src, "block").alias("block_key"),
                    hashed(F.lit(seed), "epoch", "doc_id").alias("doc_key"))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with every row repeated as often as the plan reads it."""
    times = plan(docs, **params).groupBy("doc_id", "source").agg(F.max("copies").alias("_copies"))
    cols = docs.columns
    ident, src, i, s, n, k = fresh(cols, "_id", "_src", "_i", "_s", "_n", "_k")
    held = docs.withColumn(ident, F.col("doc_id").cast("long")).withColumn(src, F.col("source"))
    read = times.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("_copies").alias(n))
    both = held.join(read, F.col(ident).eqNullSafe(F.col(i)) & F.col(src).eqNullSafe(F.col(s)))
    return both.where(F.col(n) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))) \
        .select(*[F.col(f"`{c}`") for c in cols])
