"""Byte-level BPE encoding and decoding with recursive DuckDB queries per partition.

Encoding: each match of the pattern is a word. Words are encoded once per Python
worker (a bounded cache; most of a corpus is repeated words). For the others a
recursive query unnests the token positions of every word, joins neighbours
with the merge table, takes each word's leftmost pair of minimum rank, contracts
it, and repeats until no pair of the word is in the table. A word that is itself
in the vocabulary is its own token, as in the tiktoken library.

Words of more than ``LONG`` bytes are cut into pieces of ``PIECE`` bytes, which the
same query encodes, and mended where the pieces meet. Tokens are the encoding of
their text if and only if every two neighbours are the encoding of theirs: the first
merge to cross a border between two tokens would be made in those two alone as well.
Inside a piece all neighbours are; where two pieces meet and the two tokens there
are not, some tokens on either side are encoded anew together, and more of them
until their borders hold. So work and memory grow with the length of a word.

Decoding: the token bytes of each document are aggregated in list order.

The merge table has a row (left, right, merged) for every way to cut a token
into two tokens, so it equals tiktoken's lookup of joined bytes. It follows from
the rank file, whose size bounds what each worker loads; the file must be on
every executor, as the package that holds it is.

Defined cases: null text is empty text (no ids, empty bytes); special tokens are
ordinary text; repeated rows stay; extra columns pass through; ids outside the
vocabulary make decoding fail.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import fresh, row_slices

LONG = 128  # bytes
PIECE = 64
MEND = 4  # tokens on either side of a border that does not hold; doubled until it does
CHUNK = 32_000  # words in one recursive query
CACHED_WORDS = 300_000  # per Python worker; emptied when full
SLICE_CHARS = 1_500_000
MEMORY = "500MB"

_ENCODE = """
WITH RECURSIVE step AS (
  SELECT word, ids, 0 AS round FROM start
  UNION ALL
  SELECT s.word, list_concat(list_append(s.ids[:b.at - 1], b.merged), s.ids[b.at + 2:]), s.round + 1
  FROM step s JOIN (
    SELECT word, (min(m.rank * 1048576 + p.pos) & 1048575)::INT AS at, (min(m.rank * 1048576 + p.pos) >> 20)::INT AS merged
    FROM (SELECT word, unnest(ids[:-2])::BIGINT * 16777216 + unnest(ids[2:]) AS pair,
                 unnest(range(1, len(ids))) AS pos FROM step) p
    JOIN merges m USING (pair) GROUP BY word) b USING (word))
SELECT arg_max(ids, round) AS ids FROM step GROUP BY word ORDER BY word"""

_DECODE = """
SELECT unhex(coalesce(list_aggregate(list_select(v.hexes, list_transform(t.ids, lambda x: x + 1)), 'string_agg', ''), ''))
       AS bytes
FROM docs t, vocabulary v ORDER BY t.n"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """The tables of one vocabulary in an in-process DuckDB, and the word cache."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("the ranks must be 0, 1, 2, ..")
        self.split = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes = sorted(self.ranks, key=self.ranks.__getitem__)
        self.loaded: set[str] = set()
        self._empty()

    def _need(self, table: str) -> None:
        """Loads a table on first use: a worker that only decodes has no merges."""
        if table in self.loaded:
            return
        self.loaded.add(table)
        ids = self.ranks
        if table == "merges":
            cuts = np.array([(ids[t[:k]] * 16777216 + ids[t[k:]], r) for t, r in ids.items() for k in range(1, len(t))
                             if t[:k] in ids and t[k:] in ids], np.int64).reshape(-1, 2)
            self._load("cuts", pa.table({"pair": cuts[:, 0].copy(), "rank": cuts[:, 1].copy()}))
            self.db.execute("CREATE TABLE merges AS SELECT * FROM cuts")
            self.db.unregister("cuts")
        else:
            ordered = sorted(ids, key=ids.__getitem__)
            self._load("tokens", pa.table({"id": pa.array(range(len(ordered)), pa.int32()), "hex": [t.hex() for t in ordered]}))
            self.db.execute("CREATE TABLE vocabulary AS SELECT list(hex ORDER BY id) AS hexes FROM tokens")
            self.db.unregister("tokens")

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register(name, table)

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _add(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])

    def _learn(self, words: list[str]) -> None:
        self._need("merges")
        tokens, short, long = [], [], []
        for w in words:
            b = w.encode()
            (tokens if b in self.ranks else short if len(b) <= LONG else long).append((w, b))
        self._add([w for w, _ in tokens], np.array([self.ranks[b] for _, b in tokens], np.int32), np.ones(len(tokens), np.int64))
        for k in range(0, len(short), CHUNK):
            self._add([w for w, _ in short[k:k + CHUNK]], *self._encode_short([b for _, b in short[k:k + CHUNK]]))
        for w, b in long:
            ids = self._encode_long(b)
            self._add([w], ids, np.array([len(ids)]))

    def _encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of every word; a word in the vocabulary is its own token."""
        out = [np.array([self.ranks[b]], np.int32) if b in self.ranks else None for b in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for k in range(0, len(rest), CHUNK):
            part = rest[k:k + CHUNK]
            flat, size = self._encode_short([words[i] for i in part])
            for i, ids in zip(part, np.split(flat, np.cumsum(size)[:-1]), strict=True):
                out[i] = ids
        return out

    def _encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's number of ids."""
        ends = np.concatenate([[0], np.cumsum([len(b) for b in words])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte[np.frombuffer(b"".join(words), np.uint8)]))
        self._load("start", pa.table({"word": pa.array(np.arange(len(words), dtype=np.int32)), "ids": ids}))
        got = self.db.sql(_ENCODE).to_arrow_table()["ids"].combine_chunks()
        off = got.offsets.to_numpy()
        return got.values.to_numpy(zero_copy_only=False).astype(np.int32)[off[0]:off[-1]], np.diff(off)

    def _text(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[i] for i in ids.tolist())

    def _encode_long(self, word: bytes) -> np.ndarray:
        parts = self._encode_words([word[i:i + PIECE] for i in range(0, len(word), PIECE)])
        ids, width = np.concatenate(parts), MEND
        borders = np.cumsum([len(p) for p in parts])[:-1].tolist()  # before which token pieces meet
        holds: dict[tuple[int, int], bool] = {}
        while True:
            pairs = [(int(ids[e - 1]), int(ids[e])) for e in borders]
            asked = sorted(set(pairs) - holds.keys())
            for pair, got in zip(asked, self._encode_words([self.bytes[a] + self.bytes[b] for a, b in asked]), strict=True):
                holds[pair] = got.tolist() == list(pair)
            spans: list[list[int]] = []
            for e in (e for e, pair in zip(borders, pairs, strict=True) if not holds[pair]):
                if spans and e - width <= spans[-1][1]:
                    spans[-1][1] = min(len(ids), e + width)
                else:
                    spans.append([max(0, e - width), min(len(ids), e + width)])
            if not spans:
                return ids
            out, borders, size, at = [], [], 0, 0
            for (a, b), new in zip(spans, self._encode_words([self._text(ids[a:b]) for a, b in spans]), strict=True):
                out += [ids[at:a], new]
                size += a - at
                borders += [size] if size else []
                size, at = size + len(new), b
                borders += [size] if b < len(ids) else []
            ids, width = np.concatenate([*out, ids[at:]]), 2 * width

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's end in it."""
        if len(self.known) > CACHED_WORDS:
            self._empty()
        words = [self.split(t) for t in texts]
        known = self.known
        new = {w for ws in words for w in ws if w not in known}
        if new:
            self._learn(sorted(new))
        count = sum(map(len, words))
        at = np.fromiter((known[w] for ws in words for w in ws), np.int64, count)
        size = self.ends[at + 1] - self.ends[at]
        stop = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.ends[at] - stop[:-1], size) + np.arange(stop[-1])]
        return ids, stop[np.cumsum([len(ws) for ws in words])]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        self._need("vocabulary")
        self._load("docs", pa.table({"n": pa.array(np.arange(len(ids))), "ids": ids}))
        return self.db.sql(_DECODE).to_arrow_table()["bytes"].combine_chunks().cast(pa.binary())


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary, kept between tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """``docs`` with the array column ``ids`` instead of ``text``; with ``decoded`` also
    the bytes the ids decode to, in the same worker (one set of tables, not two)."""
    out = [ids, *([decoded] if decoded else [])]
    keep = [c for c in docs.columns if c not in (text, *out)]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(ids, ArrayType(IntegerType(), False), False)]
                        + [StructField(c, BinaryType(), False) for c in out[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in row_slices(batch, batch.column(0), SLICE_CHARS):
                lists = _lists(*own.encode(part.column(0).to_pylist()))
                more = [own.decode(lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, *more], [*keep, *out])

    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(fresh(keep, "_text")[0])
    return docs.select(raw, *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the binary column ``out`` added."""
    keep = [c for c in encoded.columns if c != out]
    schema = StructType([encoded.schema[c] for c in keep] + [StructField(out, BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in row_slices(batch, batch.column(ids), SLICE_CHARS // 2):
                yield pa.RecordBatch.from_arrays([*part.columns, own.decode(part.column(ids))], [*keep, out])

    return encoded.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
