"""Exact top-k by integer inner product with pivot-table elimination.

Every vector is stored with its distances to ``PIVOTS`` pivots. For a query q
and a candidate x the triangle inequality bounds their distance from below by
max_p |d(q,p) - d(x,p)|, hence the score q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2 from
above. Candidates are evaluated in the order of that bound, until the k-th best
exact score exceeds every bound that is left.

Candidates lie in blocks of about ``BLOCK`` rows and queries in blocks of about
``QUERY_BLOCK``; each pair of blocks is a task, which returns k rows per query.
Rows are replicated by the number of blocks of the other side, never paired.

Pivots are chosen by farthest-first traversal from a bounded sample
(``PIVOT_SAMPLE`` rows by hash); any choice gives exact results.

Scores are exact at any size: vectors whose products fit int64 are multiplied as such,
the others (``wide``) as unbounded integers without bounds, and results are ranked by
a fixed-width key that holds every score that can occur.

Defined cases: vectors that are null, empty, or hold null or non-finite components take
no part; only vectors of equal length are compared. Rows are told apart by an
internal key: repeated rows, rows with equal ids and rows without an id are candidates
of their own, and only a query's own row is left out. Ties go to the smaller id, rows
without an id last. A score beyond a long is ranked exactly and shown as null. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
PIVOTS = 64
PIVOT_SAMPLE = 1024
BLOCK, QUERY_BLOCK = 4096, 1024
STEP = 256  # candidates evaluated at a time


def _floors(x: np.ndarray) -> list[int]:
    """floor(SCALE * x) of doubles as unbounded integers."""
    return [a * SCALE // b for a, b in (float(e).as_integer_ratio() for e in x)]


def _integers(batches) -> Iterator[pa.RecordBatch]:
    """(rid, vec_id, dim, v, wide, bits): int64 bytes where dim products fit int64, else decimal text."""
    for batch in batches:
        x = batch.column("x")
        values = x.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate([[0], x.value_lengths().to_numpy(zero_copy_only=False)]))
        dims, narrow, wide, bits = [], [], [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            row = values[a:b]
            dims.append(b - a)
            most = float(np.abs(row).max()) * SCALE + 1  # infinite where it overflows
            if (b - a) * most * most < 2.0 ** 62:
                narrow.append(np.floor(row * SCALE).astype(np.int64).tobytes())
                wide.append(None)
                bits.append(31)
            else:
                exact = _floors(row)
                narrow.append(None)
                wide.append(",".join(map(str, exact)))
                bits.append(max(e.bit_length() for e in exact))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(narrow, pa.binary()),
             pa.array(wide, pa.string()), pa.array(bits, pa.int32())], ["rid", "vec_id", "dim", "v", "wide", "bits"])


def integer_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rid, vec_id, dim, v, wide, bits) of the rows that take part, stored; ``rid`` tells rows apart."""
    rows = vectors.select(F.col(f"`{ident}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & fine).withColumn("rid", F.monotonically_increasing_id())
    return stored(rows.mapInArrow(_integers, "rid long, vec_id long, dim int, v binary, wide string, bits int"), "topk-int")


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal, starting from the first row."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _with_distances(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            dims, v = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            narrow = np.array([x is not None for x in v], bool)
            dist: list[bytes | None] = [None] * len(v)
            for dim in np.unique(dims[narrow]).tolist():
                at = np.flatnonzero(narrow & (dims == dim))
                f = _unpack([v[i] for i in at], np.int64).astype(np.float64)
                p = pivots.get(dim, np.zeros((1, dim), np.int64)).astype(np.float64)
                d2 = (f ** 2).sum(1)[:, None] + (p ** 2).sum(1) - 2 * f @ p.T
                for i, row in zip(at.tolist(), np.sqrt(np.maximum(d2, 0)), strict=True):
                    dist[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dist, pa.binary())], [*batch.schema.names, "dist"])
    return run


def _unpack(rows: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _big(texts: list[str]) -> np.ndarray:
    return np.array([[int(e) for e in text.split(",")] for text in texts], object)


def _pruned(q: np.ndarray, dq: np.ndarray, x: np.ndarray, dx: np.ndarray, norm: np.ndarray, usable: np.ndarray, k: int):
    """Positions and exact scores of the k best rows of ``x``, evaluated in the order of their bounds."""
    low = np.abs(dx - dq).max(1)
    total = norm + (q.astype(np.float64) ** 2).sum()
    # The slack covers rounding in the distances, so a bound is never too small.
    bound = (total - low ** 2) / 2 + 1e-9 * total + 1
    order = np.argsort(-bound, kind="stable")
    order = order[usable[order]]
    best, score = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(order), STEP):
        if len(best) == k and score[-1] > bound[order[at]]:
            break
        part = order[at:at + STEP]
        best, score = np.r_[best, part], np.r_[score, x[part] @ q]
        top = np.lexsort((best, -score))[:k]  # positions are in the order of ids
        best, score = best[top], score[top]
    return best, score


_FOUND = pa.schema([("query_rid", pa.int64()), ("query_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()),
                    ("score", pa.int64()), ("key", pa.binary())])


def _search(k: int, key_bytes: int):
    def run(cand: pa.Table, query: pa.Table) -> pa.Table:
        rows = sorted(cand.select(["vec_id", "rid", "v", "dist", "wide"]).to_pylist(),
                      key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["rid"]))
        small = np.array([i for i, r in enumerate(rows) if r["v"] is not None], np.int64)
        large = np.array([i for i, r in enumerate(rows) if r["v"] is None], np.int64)
        rids = np.array([r["rid"] for r in rows], np.int64)
        if len(small):
            x, dx = (_unpack([rows[i][c] for i in small], kind) for c, kind in (("v", np.int64), ("dist", np.float64)))
            norm = (x.astype(np.float64) ** 2).sum(1)
        wide = _big([rows[i]["wide"] for i in large]) if len(large) else None
        out = []
        for q in query.to_pylist() if rows else ():
            found = []
            own = np.frombuffer(q["v"], np.int64) if q["v"] is not None else _big([q["wide"]])[0]
            if len(small):
                usable = rids[small] != q["rid"]
                if q["v"] is not None:
                    at, scores = _pruned(own, np.frombuffer(q["dist"], np.float64), x, dx, norm, usable, k)
                else:
                    at, scores = np.flatnonzero(usable), (x.astype(object) @ own)[usable]
                found += zip(scores.tolist(), small[at].tolist(), strict=True)
            if len(large):
                usable = rids[large] != q["rid"]
                found += zip((wide @ own.astype(object))[usable].tolist(), large[usable].tolist(), strict=True)
            found.sort(key=lambda f: (-f[0], f[1]))
            for score, at in found[:k]:
                key = (score + (1 << 8 * key_bytes - 1)).to_bytes(key_bytes, "big")
                out.append((q["rid"], q["vec_id"], rows[at]["rid"], rows[at]["vec_id"],
                            score if -2 ** 63 <= score < 2 ** 63 else None, key))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_FOUND), _FOUND, strict=True)],
                        schema=_FOUND)
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, ident: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row for which
    ``is_query`` (over ``vec_id``) holds, without the row itself."""
    ints = integer_vectors(vectors, ident, vector)
    narrow = ints.where("v is not null")
    dims = [r["dim"] for r in narrow.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(8).collect()]
    pivots = {}
    for dim in dims:  # rarer lengths have one pivot, the origin
        rows = narrow.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE).collect()
        pivots[dim] = choose_pivots(np.array([np.frombuffer(r["v"], np.int64) for r in rows]), PIVOTS)
    rows = stored(ints.mapInArrow(_with_distances(pivots), "rid long, vec_id long, dim int, v binary, wide string, bits int, dist binary"),
                  "topk-dist")
    asked = F.coalesce(is_query, F.lit(False))
    n, n_query, bits, dim = rows.agg(F.count("*"), F.count_if(asked), F.max("bits"), F.max("dim")).first()
    key_bytes = (2 * (bits or 0) + (dim or 0).bit_length() + 1) // 8 + 1
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_query // QUERY_BLOCK))
    mine = lambda m, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cand = rows.withColumn("cb", mine(blocks, 1)).withColumn("qb", all_of(query_blocks))
    query = rows.where(asked).withColumn("qb", mine(query_blocks, 2)).withColumn("cb", all_of(blocks))
    near = cand.groupBy("dim", "qb", "cb").cogroup(query.groupBy("dim", "qb", "cb")).applyInArrow(
        _search(k, key_bytes), "query_rid long, query_id long, rid long, vec_id long, score long, key binary")
    best = Window.partitionBy("query_rid").orderBy(F.desc("key"), F.col("vec_id").asc_nulls_last(), "rid")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
