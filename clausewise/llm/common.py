"""Helpers shared by the training-data operators: shared-folder tables, ASCII
words, 64-bit word and shingle hashes, pairs inside sorted groups, components.

A *word* is a maximal run of bytes other than space and \\t\\n\\v\\f\\r, which is
what ``bytes.split()`` yields and what ``[^\\x20\\x09-\\x0D]+`` matches.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WORD_CACHE = 400_000  # entries; the cache is emptied when full, results do not depend on it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir`` (the folder all executors share).

    Only a purely local session may lack the setting; it gets a scratch folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="clausewise-llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the
    lineage, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once: the optimiser cannot copy ``value``
    into a lambda of ``body``, where it would run again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- hashes -----------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self):
        import xxhash

        self._hash, self._known = xxhash.xxh3_64_intdigest, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > WORD_CACHE:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self._hash(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash for each window of ``n`` words; a shorter text is one
    window of all its words, a text without words has none."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    width = min(n, len(words))
    m = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(width) * _STEP, np.uint64)
        for k in range(width):
            h = mix64(h + words[k:k + m] + _STEP)
    return h


def row_slices(batch: pa.RecordBatch, sized: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` characters (or list items) of ``sized``."""
    measure = pc.utf8_length if pa.types.is_string(sized.type) or pa.types.is_large_string(sized.type) else pc.list_value_length
    step = np.concatenate([[0], np.cumsum(measure(sized).fill_null(0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(step, step[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


# --- pairs inside sorted groups ---------------------------------------------

def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroups batches of rows sorted by ``key`` so that no group is cut."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[key].to_numpy()
        if k[0] == k[-1]:
            if held and held[-1][key].iloc[-1] != k[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(b)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1
        held.append(b.iloc[:cut])
        yield pd.concat(held, ignore_index=True)
        held = [b.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_pairs(gid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j with equal ``gid`` (sorted), lag by lag, vectorised."""
    n, lag = len(gid), 1
    i = np.flatnonzero(gid[:-1] == gid[1:])
    while len(i):
        yield i, i + lag
        lag += 1
        i = i[i + lag < n]
        i = i[gid[i] == gid[i + lag]]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index of each node's component, for nodes 0..n-1."""
    root = np.arange(n)
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# --- hot groups in blocks -----------------------------------------------------

def blocked(members: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Adds ``task_key`` so that every two members of a group meet in exactly
    one task: a group of up to ``block`` rows keeps one key, a larger one is cut
    into blocks and each pair of blocks gets a key (rows grow by the number of
    blocks, never by the number of pairs). ``blk`` tells the blocks apart and
    ``cross`` marks keys that hold two blocks. Groups of one row disappear.
    """
    counts = members.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    n_blk = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    b = members.join(counts, key).withColumn("_nb", n_blk).withColumn(
        "blk", F.pmod(F.xxhash64(F.col(ident), F.lit(7)), F.col("_nb")).cast("int"))
    other = F.explode(F.when(F.col("_nb") == 1, F.array(F.lit(0)))
                      .otherwise(F.sequence(F.lit(0), F.col("_nb") - 1)))
    b = b.withColumn("_o", other)
    return b.withColumn("task_key", F.xxhash64(F.col(key), F.least("blk", "_o"), F.greatest("blk", "_o"))) \
        .withColumn("cross", F.col("blk") != F.col("_o")).drop("_n", "_nb", "_o", key)


# --- connected components -----------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs): root is the
    smallest node of its component.

    Alternating large-star / small-star rounds. Every round aggregates with
    map-side combine and joins on the node, so a hub is split by the skew join;
    each round's edges are written to the shared folder, and nothing but one
    count and checksum reaches the driver.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .distinct(), "cc")
    before = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(roots.select("node", F.col("node").alias("root")))
