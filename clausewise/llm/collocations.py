"""Collocation mining by direct-address tiling.

Texts are cut into pieces and words; a phrase is 2 to ``LONGEST`` words in a
row inside a piece. Counting goes level by level. In a block of text (one
language) words are numbered by frequency, so that frequent pairs fall into a few
tiles of ``TILE`` x ``TILE`` pairs near the origin: such a tile is counted by
``numpy.bincount`` at direct addresses, all others as sorted coordinates. Pairs
that can be frequent are numbered by frequency again and, as left halves, paired
with the next word, which gives the triples, and so on.

A phrase reaches ``MIN_COUNT`` only if both its halves without the last and the
first word do. Tasks know that from one bit table a level (``FILTER_BITS`` bits,
whatever the corpus): a set bit may be a chance hit, which costs a row, never a
result. What Spark adds up are the phrases' texts themselves, after the blocks'
sums and map-side sums, so a very common phrase is a row a block.

Defined cases: a null text is empty and a null language ``und``; an empty table
gives no row; equal rows count as often as they stand; words are case-folded
for A-Z alone; very long texts are cut at piece borders; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stored

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
COVERED = 80  # a phrase goes if a longer one around it has this percentage of its count
SCORE_SCALE = 2_000_000
FILTER_BITS = 2 ** 24
TILE = 256
CORNER = 16  # dense tiles lie among the first CORNER x CORNER
DENSE = TILE * TILE // 16  # pairs that make a tile dense
DEALT = 16  # parts of a language that are ranked apart
BLOCK = 8_000_000  # bytes of text counted at a time

_BORDER = b"."  # stands for every end of a piece, and in no word
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r",
                        b"abcdefghijklmnopqrstuvwxyz " + _BORDER * 10)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _blocks(batches) -> Iterator[tuple[bytes, bytes]]:
    """(language, folded text) in blocks of about BLOCK bytes; documents are
    parted by a border, and a longer text is cut at borders."""
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs, texts = (batch.column(c).cast(pa.binary()) for c in ("lang", "text"))
        for lang, text in zip(langs, texts, strict=True):
            lang, text = lang.as_py(), text.as_py().translate(_FOLD)
            at = 0
            while len(text) - at > BLOCK and (cut := text.find(_BORDER, at + BLOCK)) >= 0:
                yield lang, text[at:cut]
                at = cut
            held.setdefault(lang, []).append(text[at:] if at else text)
            size += len(text) - at
            if size >= BLOCK:
                yield from ((k, _BORDER.join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, _BORDER.join(v)) for k, v in held.items())


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts pairs of numbers ranked by frequency: (pair of each occurrence,
    left number, right number and count of each pair)."""
    where = np.empty(len(left), np.int64)
    lefts, rights, counts, made = [], [], [], 0
    high = np.maximum(left, right) // TILE
    sparse = np.ones(len(left), bool)
    inner = np.flatnonzero(high < CORNER)
    tile = (left[inner] // TILE * CORNER + right[inner] // TILE).astype(np.uint16)
    size = np.bincount(tile, minlength=CORNER * CORNER)
    inner = inner[np.argsort(tile, kind="stable")]
    ends = np.cumsum(size)
    for t in np.flatnonzero(size >= DENSE):
        occ = inner[ends[t] - size[t]:ends[t]]
        sparse[occ] = False
        address = left[occ] % TILE * TILE + right[occ] % TILE
        n = np.bincount(address, minlength=TILE * TILE)
        used = np.flatnonzero(n)
        number = np.zeros(TILE * TILE, np.int64)
        number[used] = made + np.arange(len(used))
        where[occ] = number[address]
        lefts.append(t // CORNER * TILE + used // TILE)
        rights.append(t % CORNER * TILE + used % TILE)
        counts.append(n[used])
        made += len(used)
    occ = np.flatnonzero(sparse)
    width = int(right.max()) + 1 if len(right) else 1
    coded, inverse, n = np.unique(left[occ] * width + right[occ], return_inverse=True, return_counts=True)
    where[occ] = made + inverse
    return (where, np.concatenate([*lefts, coded // width]), np.concatenate([*rights, coded % width]),
            np.concatenate([*counts, n]))


def by_frequency(count: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each number or -1 where it is not allowed, numbers in rank order)."""
    ranked = np.flatnonzero(allowed)
    ranked = ranked[np.argsort(-count[ranked], kind="stable")]
    rank = np.full(len(count), -1, np.int64)
    rank[ranked] = np.arange(len(ranked))
    return rank, ranked


def _word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    start = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, start) for w in words), np.uint64, len(words))


def _words(text: bytes) -> tuple[np.ndarray, pa.Array, int]:
    """The words of a folded text as numbers, the distinct words, and the border's number."""
    spaced = b"".join((b". ", text.replace(_BORDER, b" . "), b" ."))
    found = pc.ascii_split_whitespace(pa.array([spaced], pa.string())).values.dictionary_encode()
    words = found.dictionary
    return found.indices.to_numpy().astype(np.int64), words, pc.index(words, "." ).as_py()


def _joined(left: pa.Array, right: pa.Array, i: np.ndarray, j: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(left.take(pa.array(i)), right.take(pa.array(j)), " ")


def _extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h * _ODD + word)


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h % np.uint64(len(table) * 8)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_block(lang: bytes, text: bytes, tables: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Phrases of ``len(tables) + 1`` words of a block and their counts; ``tables``
    are the bit tables of the shorter lengths. Single words come with the number of
    all words as the count of the empty phrase."""
    seq, words, border = _words(text)
    count = np.bincount(seq, minlength=len(words))
    real = np.arange(len(words)) != border
    if not tables:
        at = np.flatnonzero(real)
        return pa.concat_arrays([pa.array([""]), words.take(pa.array(at))]), np.r_[count[at].sum(), count[at]]
    hashes = _word_hashes(lang, words.cast(pa.binary()).to_pylist())
    rank, ranked = by_frequency(count, real & _passes(tables[0], hashes))
    seq = rank[seq]
    words, hashes = words.take(pa.array(ranked)), hashes[ranked]
    phrases, left, left_hash = words, seq, hashes
    for level in range(2, len(tables) + 2):
        # ``left[i]`` is the phrase of level - 1 words that starts at word i; its successor must be one too
        n = max(0, len(seq) - level + 1)
        at = np.flatnonzero((left[:n] >= 0) & (left[1:n + 1] >= 0) & (seq[level - 1:level - 1 + n] >= 0))
        pair, a, b, count = tile_counts(left[at], seq[at + level - 1])
        if level == len(tables) + 1:
            return _joined(phrases, words, a, b), count
        pair_hash = _extend(left_hash[a], hashes[b])
        rank, ranked = by_frequency(count, _passes(tables[level - 1], pair_hash))
        phrases, left_hash = _joined(phrases, words, a[ranked], b[ranked]), pair_hash[ranked]
        left = np.full(len(seq), -1, np.int64)
        left[at] = rank[pair]


def _counter(tables: list[np.ndarray]):
    def run(batches):
        for lang, text in _blocks(batches):
            phrases, count = count_block(lang, text, tables)
            if len(phrases):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(len(phrases), np.int32))),
                     phrases, pa.array(count, pa.int64())], ["lang", "phrase", "n"])
    return run


def _positions(bits: int):
    def run(batches):
        for batch in batches:
            langs, phrases = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "phrase"))
            at = np.empty(len(langs), np.uint64)
            for i, (lang, phrase) in enumerate(zip(langs, phrases, strict=True)):
                h = _word_hashes(lang, phrase.split(b" "))
                whole = h[:1]
                for k in range(1, len(h)):
                    whole = _extend(whole, h[k:k + 1])
                at[i] = whole[0] % np.uint64(bits)
            cell = (at >> np.uint64(5)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.int64(1) << (at & np.uint64(31)).astype(np.int64))],
                                             ["cell", "bit"])
    return run


def bit_table(phrases: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The bits of all phrases: ``bits`` / 8 bytes, however many phrases there are."""
    cells = phrases.mapInArrow(_positions(bits), "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[cells["cell"].to_numpy()] = cells["bit"].to_numpy().astype(np.uint32)
    return table.view(np.uint8)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, lang: str = "lang", text: str = "text",
                  bits: int = FILTER_BITS) -> list[DataFrame]:
    """For each length up to ``longest``, (lang, phrase, n) of the phrases counted at
    least ``min_count`` times; among the single words, the empty phrase counts all."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    out, tables = [], []
    for level in range(1, longest + 1):
        n = rows.mapInArrow(_counter(tables), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        out.append(stored(n.where((F.col("n") >= min_count) | (F.col("phrase") == "")), f"phrases-{level}"))
        if level < longest:
            tables.append(bit_table(out[-1].where("phrase <> ''"), bits))
    return out


def score(counts: list[DataFrame], covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more that no
    longer one covers, each at its lowest-scoring cut."""
    single = counts[0].where("phrase <> ''")
    several = None
    for c in counts[1:]:
        several = c if several is None else several.unionByName(c)
    several = several.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    parts = single.unionByName(several.select("lang", "phrase", F.col("a").alias("n")))
    span = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("left"),
                       span(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda key, name: parts.select("lang", F.col("phrase").alias(key), F.col("n").alias(name))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]) \
        .withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {SCORE_SCALE}) div (cast(l as decimal(20,0)) + r)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")) \
        .select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    inside = several.where(F.size("w") > 2).select(
        "lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("len")) \
        .select("lang", "a", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at")) \
        .groupBy("lang", span(F.col("at"), F.col("len")).alias("phrase")).agg(F.max("a").alias("outer"))
    big = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    return best.join(inside, ["lang", "phrase"], "left") \
        .where(F.col("outer").isNull() | (big("outer", 100) < big("a", covered))).drop("outer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, covered: int = COVERED,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases."""
    counts = phrase_counts(docs, min_count, longest, lang, text)
    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first the best of each part of a language, so that what meets for the ranks is DEALT * top rows at most
    part = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    best = score(counts, covered).withColumn("part", part) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top).drop("part")
    total = counts[0].where("phrase = ''").select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
