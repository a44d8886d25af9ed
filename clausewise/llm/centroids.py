"""Centroid clustering of integer vectors by Walsh-Hadamard progressive search.

Vectors and centroids are turned by the integer Walsh-Hadamard transform H, for
which |Hv - Hc|^2 = dim * |v - c|^2. Coefficients are ordered by sequency, coarse
to fine. A vector's differences to all centroids are summed over the first 1,
2, 4, .. coefficients; what is left of both sides bounds the distance from below
and above (Cauchy-Schwarz, square roots rounded up), and centroids whose lower
bound is above another's upper bound are out. Survivors are summed over all
coefficients, so distances are exact integers.

Spark reads the vectors once a round. Each task holds ``k`` sums and emits them
once, cut into 32-bit limbs, so the sums are exact at any size and what reaches
the driver is bounded by ``k * dim`` numbers, whatever the number of vectors.

Defined cases: vectors that are null, of another length than ``dim``, or hold a null
or non-finite component take no part. Components beyond +-2^21 after scaling are
computed in unbounded integers instead of int64. Repeated rows and ids are
separate rows. Rows with a null id are assigned, and start a centroid only where
other rows do not suffice; equal start hashes are ordered by the vector. With
fewer than ``k`` vectors there are fewer centroids. A distance or inertia beyond a
long is null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
ROWS = 4096  # vectors compared at a time
NARROW = 2 ** 21  # components up to this size cannot overflow int64 sums
LIMB = 32
_PART = (pa.int32(), pa.int32(), pa.int32(), pa.int64())


def kept_vectors(vectors: DataFrame, dim: int = DIM, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id long, v array<double>) of the rows that take part."""
    v = vectors.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("v").isNotNull() & (F.size("v") == dim) & fine)


def integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of rows of doubles, exact for a power of two: the rows
    that fit int64 arithmetic, and whether each row does."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    narrow = (np.abs(y) <= NARROW).all(1)
    return y, narrow


def exact_floor(x: float, scale: int) -> int:
    a, b = x.as_integer_ratio()
    return a * scale // b


def sequency(dim: int) -> np.ndarray:
    """Rows of the natural Hadamard order by number of sign changes."""
    bits = dim.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(dim)]
    return np.array([int(format(g, f"0{bits}b")[::-1], 2) if bits else 0 for g in gray])


def transform(v: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard coefficients of each row, coarse to fine."""
    n, dim = v.shape
    out, step = v, 1
    while step < dim:
        pairs = out.reshape(n, dim // (2 * step), 2, step)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([a + b, a - b], axis=2).reshape(n, dim)
        step *= 2
    return out[:, sequency(dim)]


def _root_up(x: np.ndarray) -> np.ndarray:
    """An integer at least the square root of each element."""
    if x.dtype == object:
        return np.array([math.isqrt(e) + 1 for e in x], object)
    return np.sqrt(x.astype(np.float64)).astype(np.int64) + 2


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of ``v``;
    ties go to the smaller number. ``v`` and ``c`` are int64 or both objects."""
    (n, dim), k = v.shape, len(c)
    hv, hc = transform(v), transform(c)
    rest_v, rest_c = (hv * hv).sum(1), (hc * hc).sum(1)
    row, col = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, v.dtype)
    done, upto = 0, 1
    while True:
        d = hv[row, done:upto] - hc[col, done:upto]
        part = part + (d * d).sum(1)
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        if upto == dim:
            best = np.minimum.reduceat(part, start)
            first = np.flatnonzero(part == best[row])
            first = first[np.r_[True, row[first][1:] != row[first][:-1]]]
            return col[first], best // dim
        rest_v = rest_v - (hv[:, done:upto] ** 2).sum(1)
        rest_c = rest_c - (hc[:, done:upto] ** 2).sum(1)
        both = rest_v[row] + rest_c[col]
        cross = 2 * _root_up(rest_v)[row] * _root_up(rest_c)[col]
        least = np.minimum.reduceat(part + both + cross, start)
        keep = part + np.maximum(both - cross, 0) <= least[row]
        row, col, part = row[keep], col[keep], part[keep]
        done, upto = upto, 2 * upto


def _assigned(batches, centroids: list[list[int]], scale: int):
    """(ids, integer vectors, cluster, distance) block by block; rows of one block share a dtype."""
    wide_c = np.array(centroids, object)
    narrow_c = max(abs(x) for c in centroids for x in c) <= NARROW
    dim = len(centroids[0])
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, x = part.column("id"), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            y, narrow = integers(x, scale)
            for is_narrow in (True, False):
                sel = np.flatnonzero(narrow == is_narrow)
                if not len(sel):
                    continue
                if is_narrow and narrow_c:
                    v, c = y[sel].astype(np.int64), wide_c.astype(np.int64)
                else:
                    v, c = np.array([[exact_floor(float(e), scale) for e in r] for r in x[sel]], object), wide_c
                yield ids.take(pa.array(sel)), v, *nearest(v, c)


def _sums(centroids: list[list[int]], scale: int):
    def run(batches):
        k, dim = len(centroids), len(centroids[0])
        total, count = np.zeros((k, dim), object), [0] * k
        for _, v, cluster, _ in _assigned(batches, centroids, scale):
            for j in np.unique(cluster):
                mine = v[cluster == j]
                total[j] += mine.sum(0)
                count[j] += len(mine)
        out = []
        for j in range(k):
            if count[j]:
                out.append((j, -1, 0, count[j]))
                for d in range(dim):
                    left, sign, limb = abs(int(total[j, d])), 1 if total[j, d] >= 0 else -1, 0
                    while left:
                        out.append((j, d, limb, sign * (left & (2 ** LIMB - 1))))
                        left, limb = left >> LIMB, limb + 1
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART, strict=True)], ["cluster", "dim", "limb", "part"])
    return run


def _labels(centroids: list[list[int]], scale: int):
    def run(batches):
        for ids, _, cluster, distance in _assigned(batches, centroids, scale):
            far = [int(d) if d < 2 ** 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(far, pa.int64())],
                                             ["id", "cluster", "distance"])
    return run


def start_centroids(kept: DataFrame, k: int = K, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return [[exact_floor(x, scale) for x in r["v"]] for r in first]


def next_centroids(kept: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """Componentwise floor of the mean of each centroid's vectors; empty ones stay."""
    parts = kept.mapInArrow(_sums(centroids, scale), "cluster int, dim int, limb int, part long")
    total, count = {}, {}
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        if r["dim"] < 0:
            count[r["cluster"]] = int(r["part"])
        else:
            at = r["cluster"], r["dim"]
            total[at] = total.get(at, 0) + (int(r["part"]) << (LIMB * r["limb"]))
    return [[total.get((j, d), 0) // count[j] for d in range(len(c))] if j in count else c
            for j, c in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED,
            ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every
    kept vector after ``rounds`` rounds; ``dim`` is a power of two."""
    kept = kept_vectors(vectors, dim, ident, vector)
    centroids = start_centroids(kept, k, scale, seed)
    schema = "id long, cluster int, distance long"
    if not centroids:
        none = kept.sparkSession.createDataFrame([], schema)
        return none.select(F.col("id").alias(ident), "cluster", "distance", F.lit(None).cast("long").alias("cluster_inertia"),
                           F.lit(None).cast("long").alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids, scale)
    labels = stored(kept.mapInArrow(_labels(centroids, scale), schema), "centroids")
    summed = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r["cluster"]: r["s"] for r in labels.groupBy("cluster").agg(summed.alias("s")).collect()}
    as_long = lambda s: F.lit(int(s) if s is not None and s < 2 ** 63 else None).cast("long")
    whole = None if None in per.values() else sum(per.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return labels.select(F.col("id").alias(ident), "cluster", "distance",
                         pick([as_long(per.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"),
                         as_long(whole).alias("inertia"), pick([F.lit(d) for d in digests]).alias("centroid_sha256"))
