"""Severity of toxic language: cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x) with ordered thresholds theta and one
weight vector for all of them; the output is the expected grade. Features are
log(1 + count), sparse, of the words of a vocabulary and of word beginnings of
``PREFIXES`` letters (``^abcd``), which inflected insults share; lower case.

Fitting uses at most ``SAMPLE`` labelled documents (by hash of the id). Their
words are counted in Spark; the vocabulary is the up to ``MAX_FEATURES`` words whose
log odds between toxic and other documents lie ``MIN_Z`` standard errors from
zero. ``labels`` say toxic or not; grades 1 to 3 split the toxic documents at the
terciles of their number of toxic features (grade 0: not toxic).
Scoring covers all documents and whole texts.

Defined cases: a null id keeps its row; null text is empty text; without labelled rows of both kinds every
severity is the sample's mean (0 without labels); repeated rows stay; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 20_000
MAX_FEATURES = 5_000
MIN_Z = 4.0
GRADES = 4
PENALTY, STEPS, RATE = 1e-4, 400, 0.1
SLICE_CHARS = 4_000_000

_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_"


PREFIXES = (4, 5, 6)
CACHED_WORDS = 400_000  # per task; emptied when full


def features(token: str) -> list[str]:
    """The features of one white-space token: the lower-case word without
    punctuation at its ends, and its beginnings."""
    w = token.lower().strip(_EDGE)
    return [w, *("^" + w[:n] for n in PREFIXES if len(w) > n)] if w else []


def counted(text: str) -> Counter:
    got: Counter = Counter()
    for token, n in Counter(text.split()).items():
        for f in features(token):
            got[f] += n
    return got


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Ordinal:
    """theta (GRADES - 1, increasing) and w over vocabulary indexes."""

    def __init__(self, vocabulary: dict[str, int], theta: np.ndarray, w: np.ndarray):
        self.vocabulary, self.theta, self.w = vocabulary, theta, w

    def scores(self, texts) -> np.ndarray:
        known, get, out = {}, self.vocabulary.get, np.zeros(len(texts))
        for i, t in enumerate(texts):
            if len(known) > CACHED_WORDS:
                known.clear()
            found: dict[int, int] = {}
            for token in t.split():
                cols = known.get(token)
                if cols is None:
                    cols = known[token] = tuple(k for f in features(token) if (k := get(f)) is not None)
                for k in cols:
                    found[k] = found.get(k, 0) + 1
            if found:
                out[i] = self.w[list(found)] @ np.log1p(np.fromiter(found.values(), float, len(found)))
        return out

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 2, by row."""
        return 1 - sigmoid(self.theta - score[:, None])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int):
    """Adam on the negative log likelihood; (rows, cols, values) is the sparse
    design. Thresholds are theta_0 and log increments, so they stay ordered."""
    share = np.clip(np.cumsum(np.bincount(y, minlength=GRADES))[:-1] / max(len(y), 1), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    raw = np.r_[start[0], np.log(np.maximum(np.diff(start), 0.05)), np.zeros(n_features)]
    m1, m2, k = np.zeros_like(raw), np.zeros_like(raw), GRADES - 1
    weight = 1 / max(len(y), 1)
    for step in range(1, STEPS + 1):
        theta = raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:k]))]
        w = raw[k:]
        s = np.bincount(rows, w[cols] * values, minlength=len(y))
        edges = np.r_[-np.inf, theta, np.inf]
        hi, lo = sigmoid(np.clip(edges[y + 1] - s, -40, 40)), sigmoid(np.clip(edges[y] - s, -40, 40))
        hi[y == k], lo[y == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-9)
        ds = (1 - hi - lo) * weight
        dhi, dlo = -hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        dtheta = np.bincount(np.minimum(y, k), np.where(y < k, dhi, 0), minlength=k + 1)[:k] \
            + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, dlo, 0), minlength=k)[:k]
        tail = np.cumsum(dtheta[::-1])[::-1]
        grad = np.r_[tail[0], tail[1:] * np.exp(raw[1:k]),
                     -np.bincount(cols, -ds[rows] * values, minlength=n_features) + PENALTY * w]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        raw = raw - RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:k]))], raw[k:]


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in _slices(pdf):
            got = [counted(t) for t in part["text"]]
            size = [len(c) for c in got]
            yield pd.DataFrame({"doc_id": np.repeat(part["doc_id"].to_numpy(), size),
                                "toxic": np.repeat(part["toxic"].to_numpy(), size),
                                "word": [w for c in got for w in c], "n": [n for c in got for n in c.values()]})


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = (pdf["text"].str.len().cumsum() // SLICE_CHARS).astype(int)
    for _, part in pdf.groupby(size, sort=True):
        yield part


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    chosen = labels.where("doc_id is not null and toxic is not null") \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = stored(chosen, "tox-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .join(chosen, "doc_id")
    counts = stored(texts.mapInPandas(_word_rows, "doc_id long, toxic int, word string, n int"), "tox-words")
    n_toxic, n_all = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_clean = n_all - n_toxic
    if not n_toxic or not n_clean:
        mean = 1.0 if n_all and n_toxic else 0.0
        return Ordinal({}, np.full(GRADES - 1, np.inf) if not mean else np.r_[-np.inf, np.full(GRADES - 2, np.inf)], np.zeros(0))
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (F.greatest(F.lit(n) - F.col(c), F.lit(0)) + 0.5))
    # a row is one word of one document, so plain sums (combined before the shuffle) count documents
    by_word = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    z = (odds("t", n_toxic) - odds("c", n_clean)) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    picked = by_word.withColumn("z", z).where(F.abs("z") >= MIN_Z).orderBy(F.desc(F.abs("z")), "word") \
        .limit(MAX_FEATURES).select("word", "z").collect()  # at most MAX_FEATURES rows
    vocabulary = {r["word"]: i for i, r in enumerate(picked)}
    if not vocabulary:
        return Ordinal({}, np.r_[np.log(n_clean / n_toxic), np.full(GRADES - 2, np.inf)], np.zeros(0))
    names = counts.sparkSession.createDataFrame([(r["word"], i) for i, r in enumerate(picked)], "word string, col int")
    # At most sample x vocabulary cells, as Arrow columns: no row objects on the driver.
    cells = counts.join(names, "word").select("doc_id", F.col("toxic").cast("tinyint").alias("toxic"), "col", "n").toArrow()
    ids, row = np.unique(cells["doc_id"].to_numpy(), return_inverse=True)
    row, col, n = row.astype(np.int32), cells["col"].to_numpy(), cells["n"].to_numpy()
    toxic = np.zeros(len(ids), int)
    toxic[row] = cells["toxic"].to_numpy()
    del cells
    bad = np.array([r["z"] > 0 for r in picked])
    hits = np.bincount(row, np.where(bad[col], n, 0), minlength=len(ids))
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3]) if toxic.any() else np.zeros(2)
    y = np.where(toxic == 1, 1 + (hits[:, None] > cuts).sum(1), 0)
    # Documents without any vocabulary word still count.
    rest_toxic = int(n_toxic - toxic.sum())
    y = np.r_[y, np.ones(rest_toxic, int), np.zeros(int(n_all - len(ids)) - rest_toxic, int)]
    order = np.lexsort((col, row))
    theta, w = fit_ordinal(row[order], col[order], np.log1p(n.astype(float))[order], y, len(vocabulary))
    return Ordinal(vocabulary, theta, w)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), grade (most probable), toxic (0/1: P(grade > 0) >= 1/2)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _slices(pdf):
                above = model.above(model.scores(list(part["text"])))
                p = -np.diff(np.c_[np.ones(len(part)), above, np.zeros(len(part))], axis=1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "severity": above.sum(1).round(6),
                                    "grade": p.argmax(1), "toxic": (above[:, 0] >= 0.5).astype(int)})

    # Ids travel as strings: pandas has no null integers.
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .mapInPandas(run, "doc_id string, severity double, grade int, toxic int") \
        .withColumn("doc_id", F.col("doc_id").cast("long"))
