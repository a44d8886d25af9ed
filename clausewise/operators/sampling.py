"""O-31 exact train/test split and O-30 SMOTE oversampling.

Split (O-31). The reference takes an exact ``ceil(0.2 * n)`` test rows. We
order rows by ``md5(key:seed)`` and take the first ``n_test`` per scope
without a global sort: a histogram over the first four hex digits (at most
65,536 buckets per scope), a running sum over that small table, and a rank only
inside the one bucket of each scope in which the cut lies (about n / 65,536 rows)
give the scope's cut-off hash; all rows are then tagged by comparing with it.
Membership is independent of partitioning,
unlike ``randomSplit``.

SMOTE (O-30). Nearest neighbours are exact. High-dimensional exact k-NN has
to compare every minority pair, so the pairs are never materialised as rows:
the rows of a scope (a class to be enlarged) are cut into blocks of about
``block_rows`` rows by hash, each block pair (q, r) is one cogroup task that
computes the distance matrix with NumPy and returns the k best per query row; a
last window per query row (B * k rows) keeps the k best overall. The fast
distances (after subtracting the block's mean) only discard: every row whose
fast distance is within rounding of the k-th smallest is measured again as
sqrt(sum of squared differences), and (distance, id) decides, so ties and
repeated points are right whatever their number.

Synthetic rows follow a seeded, partition-independent rule: a class's G = N_maj -
N_min samples are spread over the minority rows (G div N_min each, one more
for the first G mod N_min rows in hash order, found with the split machinery
above); sample j of base row b takes neighbour ``h1 mod min(5, N_min - 1)``
and lambda ``h2 / 2^32`` from two md5 hashes, and lies on the segment
``b + lambda * (nb - b)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKETS = 65536
# Neighbour count and test share follow the reference's libraries.
K_NEIGHBOURS = 5
TEST_FRACTION = 0.2
SEED = 42


def order_hash(keys: Sequence[str], seed: int, salt: str = "") -> Column:
    parts = [F.col(k).cast("string") for k in keys] + ([F.lit(salt)] if salt else []) + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def hash_fraction(h: Column) -> Column:
    """First eight hex digits of an md5 as BIGINT (0 .. 2^32 - 1)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def first_by_hash(df: DataFrame, scope: Sequence[str], keys: Sequence[str], n_take=None,
                  seed: int = SEED, fraction: float | None = None) -> DataFrame:
    """Adds ``in_head``: true for the first ``n_take`` rows of each scope in
    md5(keys:seed) order. ``n_take`` is a table ``scope..., n_take``, or with
    an empty scope a scalar column; without it, ceil(``fraction`` * rows), the
    rows being counted from the histogram."""
    h = order_hash(keys, seed)
    tagged = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    hist = tagged.groupBy(*scope, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    if n_take is None:
        n = hist.groupBy(*scope).agg(F.sum("_cnt").alias("_n"))
        n_take = n.select(*scope, F.ceil(F.lit(float(fraction)) * F.col("_n")).cast("long").alias("n_take"))
        n_take = n_take if scope else n_take.scalar()
    # without a scope the window runs over at most 65,536 histogram rows
    w = Window.partitionBy(*scope).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    info = hist.withColumn("_before", F.sum("_cnt").over(w) - F.col("_cnt"))
    if scope:
        info = info.join(n_take, list(scope))
    else:
        # a scalar column, never a join on a constant key (cartesian product)
        info = info.withColumn("n_take", n_take)
    # the cell in which the cut lies, and how many of its rows are in: one row per scope
    cut = info.where((F.col("_before") < F.col("n_take")) & (F.col("_before") + F.col("_cnt") >= F.col("n_take"))) \
        .select(*scope, F.col("_b").alias("_cut_b"), (F.col("n_take") - F.col("_before")).alias("_room"))
    # the cut-off hash: the n-th smallest of that one cell (about n / 65,536 rows)
    inside = tagged.join(cut, list(scope)).where(F.col("_b") == F.col("_cut_b")) if scope else \
        tagged.withColumn("_cut_b", cut.select("_cut_b").scalar()).withColumn("_room", cut.select("_room").scalar()) \
        .where(F.col("_b") == F.col("_cut_b"))
    rk = F.row_number().over(Window.partitionBy(*scope, "_b").orderBy("_h"))
    last = inside.withColumn("_rk", rk).where(F.col("_rk") == F.col("_room")).select(*scope, F.col("_h").alias("_last"))
    if scope:
        out = tagged.join(last, list(scope), "left")
    else:
        out = tagged.withColumn("_last", last.select("_last").scalar())
    return out.withColumn("in_head", F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False))).drop("_h", "_b", "_last")


def train_test_split(df: DataFrame, scope: Sequence[str], keys: Sequence[str],
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Adds ``split`` ('test' / 'train'); n_test = ceil(fraction * n) in DOUBLE."""
    out = first_by_hash(df, scope, keys, seed=seed, fraction=test_fraction)
    return (out.withColumn("split", F.when(F.col("in_head"), F.lit("test")).otherwise(F.lit("train")))
               .drop("in_head"))


# Candidate pairs of a block that are measured exactly at a time.
PAIRS = 2 ** 16


def _knn_block(k: int):
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"scope": [], "id": [], "nb_id": [], "dist": []}
        if len(q) and len(r):
            r = r.sort_values("id")
            qa = np.stack(q["vec"].to_numpy()).astype(np.float64)
            ra = np.stack(r["vec"].to_numpy()).astype(np.float64)
            qid, rid = q["id"].to_numpy(dtype=np.int64), r["id"].to_numpy(dtype=np.int64)
            centre = ra.mean(0)
            qc, rc = qa - centre, ra - centre
            qn, rn = (qc * qc).sum(1), (rc * rc).sum(1)
            # rounding of the fast distance grows with the norms and the length
            slack = 8 * np.finfo(np.float64).eps * (qa.shape[1] + 8) * ((qa * qa).sum(1).max() + (ra * ra).sum(1).max())
            for at in range(0, len(qa), 256):
                part = slice(at, at + 256)
                d2 = qn[part, None] + rn - 2.0 * qc[part] @ rc.T
                d2[qid[part, None] == rid] = np.inf
                kth = np.partition(d2, min(k, len(rid)) - 1, axis=1)[:, min(k, len(rid)) - 1]
                row, near = np.nonzero(d2 <= kth[:, None] + slack)
                other = rid[near] != qid[at + row]
                row, near = row[other] + at, near[other]
                begin = np.searchsorted(row, np.arange(at, at + len(d2) + 1))
                i = 0
                while i < len(d2):  # as many rows as have PAIRS candidates, most often all of them
                    j = max(i + 1, int(np.searchsorted(begin, begin[i] + PAIRS, "right")) - 1)
                    r_, n_ = row[begin[i]:begin[j]], near[begin[i]:begin[j]]
                    diff = qa[r_] - ra[n_]
                    dist = np.sqrt((diff * diff).sum(1))
                    order = np.lexsort((dist, r_))  # stable: candidates are in id order
                    best = order[np.arange(len(r_)) - np.searchsorted(r_, r_) < k]
                    found["id"].append(qid[r_[best]])
                    found["nb_id"].append(rid[n_[best]])
                    found["dist"].append(dist[best])
                    i = j
            found["scope"] = [np.full(sum(map(len, found["id"])), q["scope"].iloc[0])]
        kinds = {"scope": "int64", "id": "int64", "nb_id": "int64", "dist": "float64"}
        return pd.DataFrame({c: np.concatenate(v).astype(kinds[c]) if v else np.empty(0, kinds[c])
                             for c, v in found.items()})
    return run


def exact_knn(points: DataFrame, k: int = K_NEIGHBOURS, block_rows: int = 4096,
              id_col: str = "id", vec_col: str = "vec", scope_col: str | None = None) -> DataFrame:
    """``[scope,] id, nb_id, dist, nb_rank`` (1-based): the k nearest other
    points of the same scope (a BIGINT column; none: all points).

    Ties are broken by neighbour id. See the module notes for the blocking.
    """
    scope = F.col(scope_col).cast("long") if scope_col else F.lit(0).cast("long")
    p = points.select(scope.alias("scope"), F.col(id_col).cast("long").alias("id"),
                      F.col(vec_col).cast("array<double>").alias("vec"))
    sizes = p.groupBy("scope").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))), F.lit(1))
                                   .cast("int").alias("_nb"))
    p = p.join(sizes, "scope").withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_nb").cast("long")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    own = [F.col(c).alias(c) for c in ("scope", "id", "vec")]  # new columns: both sides come from one frame
    query = p.select(F.col("_blk").alias("qb"), others.alias("rb"), *own)
    ref = p.select(others.alias("qb"), F.col("_blk").alias("rb"), *own)
    cand = (query.groupBy("scope", "qb", "rb").cogroup(ref.groupBy("scope", "qb", "rb"))
            .applyInPandas(_knn_block(k), schema="scope long, id long, nb_id long, dist double"))
    w = Window.partitionBy("scope", "id").orderBy("dist", "nb_id")
    best = cand.withColumn("nb_rank", F.row_number().over(w).cast("long")).where(F.col("nb_rank") <= k)
    return best.withColumnRenamed("scope", scope_col) if scope_col else best.drop("scope")


def smote(points: DataFrame, label_col: str = "label", k: int = K_NEIGHBOURS, seed: int = SEED,
          block_rows: int = 4096, approximate_above: int | None = None, store=None) -> DataFrame:
    """Synthetic rows for every class below the largest one: ``label, base_id,
    sample_no, nb_id, lam, vec``. ``points``: ``label`` (BIGINT), ``id, vec``. A
    class of one row has no neighbour and gets none. Classes of more than
    ``approximate_above`` rows take their neighbours from random-projection buckets
    (``approx_knn``; needs ``store``), the others exact ones."""
    pts = points.select(F.col(label_col).cast("long").alias("label"), F.col("id").cast("long").alias("id"),
                        F.col("vec").cast("array<double>").alias("vec"))
    counts = pts.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.select(F.max("_n")).scalar()
    need = counts.withColumn("_g", most - F.col("_n")).where("_g > 0 and _n > 1")
    small = pts.join(need, "label")
    headed = first_by_hash(small, ["label"], ["id"], need.select("label", F.pmod("_g", "_n").alias("n_take")), seed)
    per_row = F.floor(F.col("_g") / F.col("_n")).cast("long") + F.col("in_head").cast("long")
    samples = (headed.withColumn("_m", per_row).where(F.col("_m") > 0)
               .select("label", "id", "vec", "_n",
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))).alias("sample_no")))
    h_nb = hash_fraction(order_hash(["id", "sample_no"], seed, "nb"))
    h_lam = hash_fraction(order_hash(["id", "sample_no"], seed, "lam"))
    k_eff = F.least(F.lit(k), F.col("_n") - 1).cast("long")
    samples = (samples.withColumn("nb_rank", F.pmod(h_nb, k_eff) + 1)
                      .withColumn("lam", h_lam.cast("double") / F.lit(float(2 ** 32))))
    if approximate_above is None:
        nbs = exact_knn(small, k, block_rows, scope_col="label")
    else:
        from clausewise.operators.approx_knn import approximate_knn

        few = F.col("_n") <= approximate_above
        nbs = exact_knn(small.where(few), k, block_rows, scope_col="label").unionByName(
            approximate_knn(small.where(~few), store, k, scope_col="label"))
    nbs = nbs.select("label", "id", "nb_rank", "nb_id")
    nb_vec = pts.select("label", F.col("id").alias("nb_id"), F.col("vec").alias("nb_vec"))
    joined = samples.join(nbs, ["label", "id", "nb_rank"]).join(nb_vec, ["label", "nb_id"])
    synth = F.zip_with("vec", "nb_vec", lambda a, b: a + F.col("lam") * (b - a))
    return joined.select("label", F.col("id").alias("base_id"), "sample_no", "nb_id", "lam", synth.alias("vec"))
