"""Jaccard self-join on word 5-grams with Bayesian candidate pruning.

Plan (all joins are equi-joins; texts cross one exchange at most, in step 5):

1. One pass over the texts: the set of 64-bit shingle hashes of each document,
   reduced to a set identity, the set's size, ``BANDS`` band keys and one byte
   of each MinHash value.
2. Documents with the same shingle set form one *class*; its smallest id stands
   for it from here on, weighted with the class size.
3. Classes that share a band key are candidates. Keys of one row vanish in an
   aggregate; hot keys are cut into blocks, whose pairs meet in tasks
   (``blocked``), so rows grow by the number of blocks, not of pairs.
4. In those tasks MinHash values are compared ``ROUND`` at a time. With a
   uniform prior on the similarity, m matches in n leave
   P(J >= t) = P(Binomial(n + 1, t) <= m); below ``tolerance`` the pair is
   dropped. Survivors are reported as forest edges, one row per document.
5. Documents joined by survivors form small clusters. Only their texts are read
   again; inside a cluster (blocks again) the exact Jaccard similarity of all
   pairs is computed from the shingle sets, and each task returns, per
   document, the weight of its links and one forest edge. No pair is emitted.

Probability to lose a pair of similarity exactly 0.8: below 1e-5 (bands), plus
``tolerance`` per pruning round; pairs in one cluster are verified whatever
the pruning said.

Rows are told apart by an internal key, two hashes of id and text; rows equal in
both are copies of each other. Nodes of the joins are classes, numbered once in a
stored table, so neither repeated ids nor rows without an id are mixed up.

Defined cases: null and empty texts have no shingle, are a class of their own and
link to nothing; a text of one to four words is one shingle of all its words; repeated
rows (same id twice) are copies of themselves and keep their own output rows; different
texts under one id are different documents; a row without an id links like any other,
is never the smallest id, and a class of such rows alone has a null id; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (WordHasher, blocked, components, forest, fresh, group_pairs, mix64, shingle_hashes, stored,
                     whole_groups)

THRESHOLD = 0.8
BANDS, ROWS = 24, 4  # 1 - (1 - 0.8^4)^24 = 0.999997
ROUND = 16
TOLERANCE = 1e-6
BLOCK = 512

_SKETCH = "doc_id string, key_a long, key_b long, set_a long, set_b long, n_shingles int, bands array<long>, sketch binary"


def minimum_matches(threshold: float, tolerance: float, total: int, step: int) -> dict[int, int]:
    """For n = step, 2*step, ..: the fewest equal MinHash values among n that
    leave a posterior probability of reaching ``threshold`` of ``tolerance``."""
    table = {}
    for n in range(step, total + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        table[n] = m
    return table


def minhash(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(len(sets), k) MinHash values of non-empty hash sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(sets), k), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            x = flat * odd[j]
            x ^= x >> np.uint64(32)
            out[:, j] = np.minimum.reduceat(x, starts)
    return out


def text_shingles(texts, hasher: WordHasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes(hasher(t.encode().split()))) if t else np.empty(0, np.uint64) for t in texts]


def _slices(pdf: pd.DataFrame, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Row slices of about ``chars`` characters, to bound what one step holds."""
    size = pdf["text"].str.len().fillna(0).cumsum()
    for _, part in pdf.groupby((size // chars).astype(int), sort=True):
        yield part


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher, k = WordHasher(), BANDS * ROWS
    for batch in batches:
        for pdf in _slices(batch):
            sets = text_shingles(pdf["text"], hasher)
            has = np.array([len(s) > 0 for s in sets])
            full = [s for s in sets if len(s)]
            out = pdf[["doc_id", "key_a", "key_b"]].astype({"doc_id": object})
            a, b = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            bands, sketch = [None] * len(sets), [None] * len(sets)
            if full:
                sig = minhash(full, k)
                with np.errstate(over="ignore"):
                    a[has] = [int(np.bitwise_xor.reduce(mix64(s)).astype(np.int64)) for s in full]
                    b[has] = [int(np.add.reduce(s).astype(np.int64)) for s in full]
                    key = np.zeros((len(full), BANDS), np.uint64)
                    for r in range(ROWS):
                        key = mix64(key + sig[:, r::ROWS] + np.uint64(r + 1))
                    key = mix64(key + np.arange(BANDS, dtype=np.uint64))
                low = (sig & np.uint64(0xFF)).astype(np.uint8)
                for i, n in enumerate(np.flatnonzero(has)):
                    bands[n], sketch[n] = key[i].astype(np.int64), low[i].tobytes()
            out["set_a"], out["set_b"] = a, b
            out["n_shingles"] = [len(s) for s in sets]
            out["bands"], out["sketch"] = bands, sketch
            yield out


def _prune(tolerance: float):
    need = minimum_matches(THRESHOLD, tolerance, BANDS * ROWS, ROUND)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "task_key"):
            sig = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
            size, rep = pdf["n_shingles"].to_numpy(), pdf["rep"].to_numpy()
            blk, cross = pdf["blk"].to_numpy(), pdf["cross"].to_numpy()
            alive = []
            for i, j in group_pairs(pdf["task_key"].to_numpy()):
                ok = (~cross[i] | (blk[i] != blk[j])) & (rep[i] != rep[j])
                ok &= np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j])
                i, j = i[ok], j[ok]
                m = np.zeros(len(i), np.int32)
                for n, least in need.items():
                    m += (sig[i, n - ROUND:n] == sig[j, n - ROUND:n]).sum(1, dtype=np.int32)
                    stay = m >= least
                    i, j, m = i[stay], j[stay], m[stay]
                if len(i):
                    alive.append((i, j))
            root = forest(len(pdf), alive)
            moved = np.flatnonzero(root != np.arange(len(pdf)))
            yield pd.DataFrame({"a": rep[moved], "b": rep[root[moved]]})

    return run


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher, seen = WordHasher(), set()
    for batch in batches:
        batch = batch[~(batch["rep"].isin(seen) | batch["rep"].duplicated())]  # repeated rows have one text
        seen.update(batch["rep"])
        for pdf in _slices(batch):
            out = pdf[["rep", "weight", "root"]].copy()
            out["shingles"] = [s.tobytes() for s in text_shingles(pdf["text"], hasher)]
            yield out


def link_counts(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, same: bool):
    """Pairs (i, j) of ``first`` x ``second`` with exact Jaccard >= THRESHOLD.

    For each i the members of its set are marked in the block's vocabulary and
    all of ``second`` is intersected with it in one vectorised sum."""
    ids, local = np.unique(np.concatenate([sets[x] for x in second]), return_inverse=True)
    size = np.array([len(sets[x]) for x in second])
    starts = np.cumsum(np.r_[0, size[:-1]])
    mark = np.zeros(len(ids) + 1, np.int32)
    for p, x in enumerate(first):
        at = np.searchsorted(ids, sets[x])
        at = at[ids[np.minimum(at, len(ids) - 1)] == sets[x]]
        mark[at] = 1
        inter = np.add.reduceat(mark[local], starts)
        mark[at] = 0
        hit = inter >= THRESHOLD * (len(sets[x]) + size - inter) - 1e-9
        if same:
            hit[:p + 1] = False
        for j in np.flatnonzero(hit):
            yield x, second[j]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for big in whole_groups(batches, "task_key"):
        for _, pdf in big.groupby("task_key", sort=False):
            pdf = pdf.drop_duplicates("rep")
            sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
            rep, weight, blk = pdf["rep"].to_numpy(), pdf["weight"].to_numpy(), pdf["blk"].to_numpy()
            links = np.zeros(len(pdf), np.int64)
            if pdf["cross"].iloc[0]:
                low = np.flatnonzero(blk == blk.min())
                high = np.flatnonzero(blk != blk.min())
                pairs = link_counts(sets, low, high, False) if len(low) and len(high) else iter(())
            else:
                every = np.arange(len(pdf))
                pairs = link_counts(sets, every, every, True)
            found = np.array(list(pairs), np.int64).reshape(-1, 2)
            np.add.at(links, found[:, 0], weight[found[:, 1]])
            np.add.at(links, found[:, 1], weight[found[:, 0]])
            root = forest(len(pdf), [(found[:, 0], found[:, 1])])
            some = np.flatnonzero(links)
            yield pd.DataFrame({"rep": rep[some], "links": links[some], "to": rep[root[some]]})


_KEY = ["key_a", "key_b"]
_SET = ["set_a", "set_b", "n_shingles"]


def _row_key(ident: str, text: str) -> list[Column]:
    i, t = F.col(f"`{ident}`").cast("long"), F.col(f"`{text}`")
    parts = [i.isNull(), i, t.isNull(), t]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(17), *parts)]


def _rows(docs: DataFrame, text: str, ident: str) -> DataFrame:
    # ids travel as text: pandas would turn a column with nulls into doubles
    return docs.select(F.col(f"`{ident}`").cast("long").cast("string").alias("doc_id"),
                       *[k.alias(n) for k, n in zip(_row_key(ident, text), _KEY, strict=True)], F.col(f"`{text}`").alias("text"))


def _first(id_col: str = "doc_id"):
    """The row that stands for a group: smallest id, rows without one last."""
    return F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), *_KEY))


def _linked(docs: DataFrame, text: str, ident: str, tolerance: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(row sketches, classes): classes ``set_a, set_b, n_shingles, cid, first, weight,
    links, root, top``; ``first`` is the row standing for the class, ``top`` that of its component."""
    src = _rows(docs, text, ident)
    sketches = stored(src.mapInPandas(_sketch, _SKETCH), "ngram-sketch")
    sketches = sketches.withColumn("doc_id", F.col("doc_id").cast("long"))
    some = sketches.where("n_shingles > 0")
    classes = some.groupBy(*_SET).agg(_first().alias("first"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-class")

    # The sketch of each class's first row, fetched by that row's key: no hot key here.
    firsts = classes.select("cid", *[F.col(f"first.{k}").alias(k) for k in _KEY], "set_a", "set_b")
    rep_sketch = some.join(firsts, [*_KEY, "set_a", "set_b"]).dropDuplicates(["cid"]) \
        .select(F.col("cid").alias("rep"), "n_shingles", "bands", "sketch")
    keyed = rep_sketch.select("rep", F.explode("bands").alias("band"))
    held = blocked(keyed, "band", "rep", block)
    tasks = held.join(rep_sketch.select("rep", "n_shingles", "sketch"), "rep")
    survivors = tasks.repartition("task_key").sortWithinPartitions("task_key").mapInPandas(
        _prune(tolerance), "a long, b long")
    clusters = components(survivors)

    chosen = clusters.select(F.col("node").alias("cid"), "root").join(classes.select("cid", "weight", "first"), "cid") \
        .select(F.col("cid").alias("rep"), "root", "weight", *[F.col(f"first.{k}").alias(k) for k in _KEY])
    texts = src.select(*_KEY, "text").join(chosen, _KEY).select("rep", "weight", "root", "text")
    sets = texts.mapInPandas(_expand, "rep long, weight long, root long, shingles binary")
    checked = stored(blocked(sets, "root", "rep", block).repartition("task_key").sortWithinPartitions("task_key")
                     .mapInPandas(_verify, "rep long, links long, to long"), "ngram-links")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    tied = roots.withColumnRenamed("node", "cid").join(links.withColumnRenamed("rep", "cid"), "cid")
    tops = tied.join(classes.select("cid", "first"), "cid").groupBy("root").agg(F.min("first").alias("top"))
    return sketches, classes.join(tied.join(tops, "root"), "cid", "left")


def join(docs: DataFrame, text: str = "text", ident: str = "doc_id", tolerance: float = TOLERANCE,
         block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (smallest id of the
    documents connected by links of similarity >= 0.8), ``copy_id`` (smallest id
    with the same shingle set), ``n_links`` (other rows linked to it)."""
    sketches, classes = _linked(docs, text, ident, tolerance, block)
    # Classes of one row without links need no join back: most rows of a corpus.
    several = classes.where("weight > 1 or links is not null").select(
        *_SET, F.coalesce("top.id", "first.id").alias("class_id"), F.col("first.id").alias("copy_id"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.lit(True).alias("found"))
    full = sketches.where("n_shingles > 0").select("doc_id", *_SET).join(several, _SET, "left").select(
        "doc_id", F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("found"), F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = sketches.where("n_shingles = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"),
        F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)


def deduplicate(docs: DataFrame, text: str = "text", ident: str = "doc_id", tolerance: float = TOLERANCE,
                block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each class, one of the smallest id (of rows equal in id
    and text any one); documents without a word all stay."""
    sketches, classes = _linked(docs, text, ident, tolerance, block)
    several = classes.where("weight > 1 or links is not null").select(*_SET, F.coalesce("top", "first").alias("top"))
    # Decisions by row key, for the rows of classes that have others; few keys stand for several rows.
    rows = sketches.select("doc_id", *_KEY, *_SET).join(several, _SET)
    stands = F.first((F.col("top.key_a") == F.col("key_a")) & (F.col("top.key_b") == F.col("key_b")))
    fate = stored(rows.groupBy(*_KEY).agg(F.count("*").alias("rows"), stands.alias("stands")), "ngram-fate")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    names = fresh(docs.columns, "_a", "_b", "_stands", "_rows")
    fate = fate.select(*[F.col(c).alias(n) for c, n in zip([*_KEY, "stands", "rows"], names, strict=True)])
    keyed = docs.select(*cols, *[k.alias(n) for k, n in zip(_row_key(ident, text), names[:2], strict=True)])
    one = f"`{names[2]}` is null or (`{names[2]}` and `{names[3]}` = 1)"
    kept = keyed.join(fate, names[:2], "left").where(one).select(*cols)
    repeated = fate.where(f"`{names[2]}` and `{names[3]}` > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, names[:2]).dropDuplicates(names[:2]).select(*cols))
    return kept
