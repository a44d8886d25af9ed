"""O-30 above a size: nearest neighbours from random-projection buckets.

A table deals points to 2^m buckets by the sides of m random hyperplanes, each through
the median of its projection in a bounded sample (``SAMPLE`` rows by hash), so
buckets are about even; m follows from the number of rows. A point is stored once a
table and looks into its own bucket and into the ``PROBES`` - 1 buckets behind the
planes nearest to it. In a bucket distances are exact (the code of the exact search),
and a point's neighbours are the best of all tables.

A bucket that is still too large (a tight cluster) is split again by planes through the
cluster's own mean; what even those cannot split (equal points) is dealt by hash, and
such points find neighbours among their part. So the work grows with the rows, not
with their square. ``sampling.exact_knn`` stays the exact way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.operators.sampling import K_NEIGHBOURS, SEED, _knn_block

TABLES, PROBES = 12, 8
BUCKET_ROWS = 1024  # rows a bucket should have
SAMPLE = 4096
SPLITS = 8  # further planes for a bucket that is too large


def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def _codes(planes: np.ndarray, middle: np.ndarray, tables: int, bits: int, probes: int):
    """For each batch of points: own bucket of every table, and all buckets looked into."""
    power = 1 << np.arange(bits)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            far = (x @ planes - middle).reshape(len(x), tables, bits + SPLITS)
            side = far[:, :, :bits] > 0
            own = (side * power).sum(2) + (np.arange(tables) << bits)
            near = np.argsort(np.abs(far[:, :, :bits]), axis=2, kind="stable")[:, :, :probes - 1]
            flipped = own[:, :, None] ^ power[near] if bits else own[:, :, None][:, :, :0]
            every = np.concatenate([own[:, :, None], flipped], 2)
            out = pdf[["scope", "id"]].loc[pdf.index.repeat(tables)].reset_index(drop=True)
            out["key"] = own.ravel()
            out["probes"] = list(every.reshape(-1, every.shape[2]))
            out["rest"] = list(far[:, :, bits:].reshape(-1, SPLITS))
            yield out
    return run


def approximate_knn(points: DataFrame, store, k: int = K_NEIGHBOURS, id_col: str = "id", vec_col: str = "vec",
                    scope_col: str | None = None, tables: int = TABLES, probes: int = PROBES,
                    bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """``[scope,] id, nb_id, dist, nb_rank`` as ``sampling.exact_knn``, nearly all of them.
    ``store`` writes a table to the shared folder and reads it back."""
    scope = F.col(scope_col).cast("long") if scope_col else F.lit(0).cast("long")
    # a point goes to tables * probes buckets: vectors of floats are sent as such, and become doubles in the task
    vec = F.col(vec_col) if points.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
    p = store(points.select(scope.alias("scope"), F.col(id_col).cast("long").alias("id"), vec.alias("vec")), "lsh-points")
    sample = p.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()
    schema = "scope long, id long, nb_id long, dist double"
    if not sample:
        none = p.sparkSession.createDataFrame([], schema + ", nb_rank long")
        return none.withColumnRenamed("scope", scope_col) if scope_col else none.drop("scope")
    largest = p.groupBy("scope").count().agg(F.max("count")).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, largest / bucket_rows)))))
    s = np.array([r["vec"] for r in sample], np.float64)
    planes = _planes(s.shape[1], tables * (bits + SPLITS), seed)
    middle = np.median(s @ planes, axis=0)
    coded = store(p.mapInPandas(_codes(planes, middle, tables, bits, probes),
                                "scope long, id long, key long, probes array<long>, rest array<double>"), "lsh-codes")

    # buckets that hold far more rows than they should: the means of the further projections, and how many of them split it
    means = [F.avg(F.element_at("rest", i + 1)).alias(f"a{i}") for i in range(SPLITS)]
    hot = coded.groupBy("scope", "key").agg(F.count("*").alias("rows"), *means).where(F.col("rows") > 4 * bucket_rows) \
        .withColumn("planes", F.least(F.ceil(F.log2(F.col("rows") / bucket_rows)), F.lit(SPLITS)).cast("int")) \
        .withColumn("mean", F.array(*[f"a{i}" for i in range(SPLITS)])).select("scope", "key", "rows", "planes", "mean")
    hot = store(hot, "lsh-hot")

    def split(rows: DataFrame) -> DataFrame:
        """Adds ``part``: the sides of a hot bucket's own planes."""
        r = rows.join(hot.select("scope", "key", "planes", "mean"), ["scope", "key"], "left")
        side = F.aggregate(F.sequence(F.lit(1), F.col("planes")), F.lit(0), lambda a, i: a * 2 + F.when(
            F.element_at("rest", i) > F.element_at("mean", i), 1).otherwise(0))
        return r.withColumn("part", F.coalesce(F.when(F.col("planes") > 0, side), F.lit(0))).drop("planes", "mean")

    kept = split(coded.select("scope", "id", "key", "rest"))
    sizes = kept.groupBy("scope", "key", "part").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * bucket_rows)
    pieces = store(sizes.withColumn("pieces", F.ceil(F.col("_n") / bucket_rows).cast("int")).drop("_n"), "lsh-equal")
    deal = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece")
    bucket = ["scope", "key", "part", "piece"]

    def dealt(rows: DataFrame) -> DataFrame:
        r = rows.join(pieces, ["scope", "key", "part"], "left").select("scope", "id", "key", "part", deal)
        r = r.join(p.select("scope", "id", "vec"), ["scope", "id"])
        return r.select(*[F.col(c).alias(c) for c in (*bucket, "id", "vec")])  # new columns: both sides come from one frame

    asked = split(coded.select("scope", "id", F.explode("probes").alias("key"), "rest"))
    # as many tasks as configured: the rows are few bytes but much work, and AQE would join their partitions
    width = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, r = (dealt(rows).repartition(width, *bucket).groupBy(*bucket) for rows in (asked, kept))
    found = q.cogroup(r).applyInPandas(_in_bucket(k), schema)
    best = Window.partitionBy("scope", "id").orderBy("dist", "nb_id")
    found = found.repartition("scope", "id")  # serves both the distinct rows and the window
    top = found.distinct().withColumn("nb_rank", F.row_number().over(best).cast("long")).where(F.col("nb_rank") <= k)
    return top.withColumnRenamed("scope", scope_col) if scope_col else top.drop("scope")


def _in_bucket(k: int):
    exact = _knn_block(k)

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        # several tables' probes may bring a point twice; one copy of each is enough
        return exact(q.drop_duplicates("id"), r.drop_duplicates("id"))
    return run


def recall(found: DataFrame, exact: DataFrame, keys: tuple[str, ...] = ("id",)) -> float:
    """Share of the exact neighbours that are among the found ones."""
    hit = exact.select(*keys, "nb_id").join(found.select(*keys, "nb_id"), [*keys, "nb_id"], "left_semi").count()
    return hit / max(1, exact.count())
