"""Repeated passages: MinHash banding of paragraphs, exact verification, components.

Units of three kinds are compared across all documents:

* paragraphs (lines) of at least ``MIN_UNIT`` words, by MinHash: ``band_count``
  tunes the number of bands so that a pair at the threshold collides with
  probability ``RECALL``; colliding paragraphs are verified by exact Jaccard
  similarity of their word 5-grams;
* sentences (cut after ``. ! ?``; a shorter one joins the next) of at least
  ``MIN_SENTENCE`` words, by their words, so that a passage set into the middle
  of a longer paragraph is found too;
* chunks, whose borders come from the words alone: a word 5-gram is an anchor if
  its hash is the least of some ``WINDOW`` consecutive ones in the document
  (across lines), and a chunk runs from one anchor to the end of the next. Two
  places that share 2 * ``WINDOW`` + 4 words share a chunk, whatever stands
  around them. A stretch of repeated chunks is extended word by word beyond its two
  ends, to where the places differ (``reach``), so every shared run of that many words
  is found in full.

Sentences and chunks are counted by hash first. What is repeated goes into a table of
a fixed number of bits, and only sentences and chunks found in it become rows at
all; a chance hit has no partner in the exact join after it.

Equal units are one class from the start (a hash of their words); only one
representative of each paragraph class is banded, and shingle sets are made for
colliding paragraphs only. Edges of verified pairs give
components; all members of a component are repeats of its first occurrence
(smallest document id, then position), which stays. Runs of repeated sentences
and chunks count once they reach ``MIN_PASSAGE`` words; spans are word numbers in
the document, end exclusive.

Hot keys: equal units meet in aggregates only; large buckets are cut into blocks
(``blocked``) and tasks report forest edges, not pairs.

Defined cases: documents without an id are not compared; null text is empty text; texts without long enough units have no
rows; a unit repeated inside one document only is a repeat as well; repeated rows
count as one document read twice (same spans, one row); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (SHINGLE, WordHasher, blocked, components, forest, fresh, group_pairs, mix64, shingle_hashes, stored,
                     whole_groups)
from .ngram_join import link_counts, minhash
from .suffix_dedup import _has_bit, bit_table

THRESHOLD = 0.8
RECALL = 0.999
ROWS = 3
MIN_UNIT = 16
MIN_SENTENCE = 6
MIN_PASSAGE = 16
WINDOW = 16  # a power of two
BLOCK = 512
SMALL = 8
SEEN = 200_000  # continuations a task remembers having given

_UNIT = "doc_id long, kind int, pos int, start int, end int, n_words int, unit long, bands array<long>"


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Fewest bands of ``rows`` values at which similarity ``threshold`` collides with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


_ENDS = frozenset(b".!?")


def range_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each range of word hashes (order counts)."""
    size = ends - starts
    if not len(size):
        return np.empty(0, np.int64)
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        mixed = mix64(h[np.repeat(starts, size) + at] ^ mix64((at + 1).astype(np.uint64)))
        return np.add.reduceat(mixed, first).astype(np.int64)


def unit_ranges(lines: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
    """(kind, first word, end word) of a text's units, lines given as words: kind 0
    paragraph, 1 sentence."""
    at = 0
    for words in lines:
        n = len(words)
        if n >= MIN_UNIT:
            yield 0, at, at + n
        begin = 0
        if n >= MIN_SENTENCE:
            for i, w in enumerate(words):
                if w[-1] in _ENDS and i + 1 - begin >= MIN_SENTENCE:
                    yield 1, at + begin, at + i + 1
                    begin = i + 1
            if n - begin >= MIN_SENTENCE:
                yield 1, at + begin, at + n
        at += n


def _slide(x: np.ndarray, least) -> np.ndarray:
    """``least`` (minimum or maximum) of every ``WINDOW`` consecutive values."""
    step = 1
    while step < WINDOW:
        x = least(x[:-step], x[step:])
        step *= 2
    return x


def chunk_ranges(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of the chunks of texts that follow each other: ``sizes``
    are their numbers of words, ``grams`` the hashes of the word 5-grams of all."""
    end = np.repeat(np.cumsum(sizes), sizes)[:len(grams)]
    least = _slide(grams, np.minimum)
    inside = np.arange(len(least)) + WINDOW + SHINGLE - 1 <= end[:len(least)]
    pad = np.zeros(WINDOW - 1, np.uint64)
    top = _slide(np.concatenate([pad, np.where(inside, least, np.uint64(0)), pad]), np.maximum)[:len(grams)]
    at = np.flatnonzero((top == grams[:len(top)]) & (top > 0))
    same = end[at[:-1]] == end[at[1:]]
    return at[:-1][same], at[1:][same] + SHINGLE


def _bands(sets: list[np.ndarray], bands: int) -> list[np.ndarray]:
    sig = minhash(sets, bands * ROWS)
    key = np.zeros((len(sets), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix64(key + sig[:, r::ROWS] + np.uint64(r + 1))
        key = mix64(key + np.arange(bands, dtype=np.uint64))
    return list(key.astype(np.int64))


def _slices(pdf: pd.DataFrame, chars: int = 3_000_000) -> Iterator[pd.DataFrame]:
    size = (pdf["text"].str.len().cumsum() // chars).astype(int)
    for _, part in pdf.groupby(size, sort=True):
        yield part


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Slices of texts with the word hashes ``h`` and 5-gram hashes ``grams`` of all, and per
    unit ``doc`` (row of the slice), ``kind``, ``pos``, ``start``, ``end`` (in the text), ``at`` (where the
    text begins in ``h``) and ``unit`` (hash)."""
    hasher = WordHasher()
    for batch in batches:
        for pdf in _slices(batch):
            found, base, every, sizes = [], 0, [], []
            for d, text in enumerate(pdf["text"]):
                lines = [x.split() for x in text.encode().split(b"\n")]
                found += [(d, k, i, s, e, base) for i, (k, s, e) in enumerate(unit_ranges(lines))]
                for words in lines:
                    every += words
                    base += len(words)
                sizes.append(sum(map(len, lines)))
            h = hasher(every)
            del every
            grams = shingle_hashes(h)  # windows inside a paragraph are those of the whole text
            low, high = chunk_ranges(grams, np.array(sizes))
            owner = np.repeat(np.arange(len(sizes)), sizes)[low]
            first = (np.cumsum(sizes) - sizes)[owner]
            doc, kind, pos, start, end, at = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 6
            cols = {"doc": (doc, owner), "kind": (kind, np.full(len(low), 2)), "pos": (pos, low - first), "start": (start, low - first),
                    "end": (end, high - first), "at": (at, first)}
            out = {c: np.concatenate(v) for c, v in cols.items()}
            out["unit"] = range_hashes(h, out["start"] + out["at"], out["end"] + out["at"])
            yield out | {"pdf": pdf, "grams": grams}


def _unit_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of every sentence and chunk, as the key ``anchor`` of a bit table."""
    for u in _units(batches):
        hashes, n = np.unique(u["unit"][u["kind"] > 0], return_counts=True)
        yield pd.DataFrame({"anchor": hashes, "n": n})


def _unit_rows(bands: int, table: np.ndarray):
    """All paragraphs with their band keys, and the sentences and chunks that ``table`` knows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for u in _units(batches):
            use = np.flatnonzero((u["kind"] == 0) | _has_bit(table, u["unit"]))
            doc, kind, pos, start, end, at, unit = (u[c][use] for c in ("doc", "kind", "pos", "start", "end", "at", "unit"))
            keys, line = [None] * len(use), np.flatnonzero(kind == 0)
            if len(line):
                low, high = (start + at)[line], (end + at)[line] - SHINGLE + 1
                for i, k in zip(line, _bands([u["grams"][a:b] for a, b in zip(low, high, strict=True)], bands), strict=True):
                    keys[i] = k
            if len(use):
                yield pd.DataFrame({"doc_id": u["pdf"]["doc_id"].to_numpy()[doc], "kind": kind, "pos": pos, "start": start, "end": end,
                                    "n_words": end - start, "unit": unit, "bands": keys})
    return run


def _shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingle sets of the wanted paragraphs of each text."""
    hasher = WordHasher()
    for pdf in batches:
        for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
            words = text.encode().split()
            sets = [np.unique(shingle_hashes(hasher(words[w["start"]:w["end"]]))) for w in wanted]
            yield pd.DataFrame({"unit": [w["unit"] for w in wanted], "shingles": [x.tobytes() for x in sets]})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest edges of the pairs with exact Jaccard >= THRESHOLD. Pairs of small
    groups are intersected one by one, groups beyond ``SMALL`` a row at a time
    against the whole group (``link_counts``)."""
    for pdf in whole_groups(batches, "task_key"):
        key = pdf["task_key"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        size, unit = np.array([len(s) for s in sets]), pdf["unit"].to_numpy()
        blk, cross = pdf["blk"].to_numpy(), pdf["cross"].to_numpy()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        small = np.flatnonzero(np.repeat(count, count) <= SMALL)
        found = []
        for i, j in group_pairs(key[small]):
            i, j = small[i], small[j]
            ok = (~cross[i] | (blk[i] != blk[j])) & (unit[i] != unit[j])
            ok &= np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j])
            i, j = i[ok], j[ok]
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)],
                            np.int64)
            hit = both >= THRESHOLD * (size[i] + size[j] - both) - 1e-9
            if hit.any():
                found.append((i[hit], j[hit]))
        for at, n in zip(first[count > SMALL], count[count > SMALL], strict=True):
            rows = np.arange(at, at + n)
            low = rows[blk[rows] == blk[rows].min()] if cross[at] else rows
            high = rows[blk[rows] != blk[rows].min()] if cross[at] else rows
            if len(high):
                links = np.array(list(link_counts(sets, low, high, not cross[at])), np.int64).reshape(-1, 2)
                found.append((links[:, 0], links[:, 1]))
        root = forest(len(pdf), found)
        moved = np.flatnonzero(unit[root] != unit)
        yield pd.DataFrame({"a": unit[moved], "b": unit[root[moved]]})


def _edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each wanted chunk border the ``n`` words beside it (up to ``WINDOW`` - 1), as the
    hash ``last`` of all of them with the chunk's class and side, and where the task has not
    given that one yet as ``keys``, the hashes of the first 1, 2, .. of them."""
    hasher, seen = WordHasher(), set()
    for pdf in batches:
        out = []
        for doc, text, wanted in zip(pdf["doc_id"], pdf["text"], pdf["wanted"], strict=True):
            h = hasher(text.encode().split())
            at, side = (np.array([w[c] for w in wanted], np.int64) for c in ("at", "side"))
            room = np.clip(np.where(side == 0, at, len(h) - at), 0, WINDOW - 1)
            name = np.array([w["class_id"] for w in wanted], np.int64)
            keys = np.zeros((len(at), WINDOW - 1), np.int64)
            with np.errstate(over="ignore"):
                key = mix64(name.astype(np.uint64) + side.astype(np.uint64) + np.uint64(1))
                for j in range(room.max(initial=0)):
                    word = np.where(side == 0, at - 1 - j, at + j)
                    key = mix64(key + h[np.clip(word, 0, len(h) - 1)] + np.uint64(j + 1))
                    keys[:, j] = key.astype(np.int64)
            for a, s, c, k, n in zip(at, side, name, keys, room, strict=True):
                if n:
                    last = int(k[n - 1])
                    out.append((doc, a, s, c, n, last, None if last in seen else k[:n]))
                    seen.add(last)
            if len(seen) > SEEN:
                seen.clear()
        yield pd.DataFrame(out, columns=["doc_id", "at", "side", "class_id", "n", "last", "keys"])


def reach(src: DataFrame, members: DataFrame) -> DataFrame:
    """The words beside repeated chunks that repeat with them: rows like those of
    ``repeated_units``, words with an earlier copy apart from first ones.

    A chunk ends with the 5-gram that the next one begins with, so nothing is asked on
    a side of a class where the chunks beyond are repeated themselves everywhere. Copies
    mostly go on alike: equal continuations are one group, and only groups are compared
    word by word."""
    line = Window.partitionBy("doc_id").orderBy("start", "end")
    chunks = members.where("kind = 2").select(
        "doc_id", "class_id", "start", "end", F.lag("end").over(line).alias("before"), F.lead("start").over(line).alias("after"))
    edges = chunks.select("doc_id", "class_id", F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.lit(0).alias("side"), (F.col("before") - SHINGLE).eqNullSafe(F.col("start")).alias("inner")),
        F.struct(F.col("end").alias("at"), F.lit(1).alias("side"), (F.col("after") + SHINGLE).eqNullSafe(F.col("end")).alias("inner"))))
        .alias("e")).select("doc_id", "class_id", "e.*")
    edges = stored(edges, "dedup-borders")
    ends = edges.groupBy("class_id", "side").agg(F.min("inner").alias("inner")).where("not inner").select("class_id", "side")
    wanted = edges.join(ends, ["class_id", "side"]).groupBy("doc_id").agg(
        F.collect_list(F.struct("at", "side", "class_id")).alias("wanted"))
    beside = stored(src.join(wanted, "doc_id").mapInPandas(
        _edge_rows, "doc_id long, at int, side int, class_id long, n int, last long, keys array<long>"), "dedup-edges")
    place = F.struct("doc_id", "at")
    groups = stored(beside.groupBy("last").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.first("keys", True).alias("keys")),
                    "dedup-continuations")
    heads = groups.select("last", "lo", "hi", F.posexplode("keys").alias("j", "key"))
    shared = heads.groupBy("key").agg(F.min("lo").alias("k_lo"), F.max("hi").alias("k_hi")).where("k_lo <> k_hi")
    far = heads.join(shared, "key").groupBy("last").agg(
        (F.max("j") + 1).alias("n_all"), F.coalesce(F.max(F.when(F.col("k_lo") != F.col("lo"), F.col("j") + 1)), F.lit(0)).alias("n_first"),
        F.first("lo").alias("lo"), F.min("k_lo.doc_id").alias("lo_doc"), F.max(F.col("k_lo.doc_id") < F.col("k_hi.doc_id")).alias("across"))
    # the first place of a group has what earlier groups share with it, any other place all of it
    far = beside.drop("keys").join(far, "last").withColumn("n_later", F.when(
        (F.col("lo.doc_id") == F.col("doc_id")) & (F.col("lo.at") == F.col("at")), F.col("n_first")).otherwise(F.col("n")))
    turn = F.when(F.col("side") == 0, -1).otherwise(1)

    def piece(a, b, doc: str, first: bool):
        a, b = F.col("at") + turn * a, F.col("at") + turn * b
        return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), F.col(doc).alias("first_doc"),
                        F.lit(first).alias("first"))
    pieces = far.select("doc_id", "class_id", "across", F.explode(F.array(
        piece(F.lit(0), F.col("n_later"), "lo_doc", False), piece(F.col("n_later"), F.col("n_all"), "doc_id", True))).alias("p"))
    return pieces.where("p.start < p.end").select(
        "doc_id", F.lit(2).alias("kind"), F.col("p.start").alias("pos"), "p.start", "p.end",
        (F.col("p.end") - F.col("p.start")).alias("n_words"), "class_id", "p.first_doc", "across", "p.first")


def repeated_units(docs: DataFrame, text: str = "text", ident: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Every unit that repeats: doc_id, kind, pos, start, end, n_words, class_id, first_doc, n_docs, keep."""
    src = docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc_id is not null")
    counts = src.mapInPandas(_unit_hashes, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    table = bit_table(counts.where("n > 1"))
    rows = stored(src.mapInPandas(_unit_rows(band_count(), table), _UNIT), "dedup-units")
    # Equal paragraphs first: one row per class, with one place where it stands.
    lines = stored(rows.where("kind = 0").groupBy("unit").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "end")).alias("at"), F.first("bands").alias("bands")),
        "dedup-lines")
    held = stored(blocked(lines.select("unit", F.explode("bands").alias("band")), "band", "unit", block), "dedup-buckets")
    # Shingle sets are made for colliding paragraphs only, from the texts that hold them.
    wanted = held.select("unit").distinct().join(lines, "unit").groupBy("at.doc_id").agg(
        F.collect_list(F.struct("unit", "at.start", "at.end")).alias("wanted"))
    sets = stored(src.join(wanted, "doc_id").mapInPandas(_shingle_rows, "unit long, shingles binary")
                  .dropDuplicates(["unit"]), "dedup-sets")
    pairs = held.join(sets, "unit").repartition("task_key").sortWithinPartitions("task_key") \
        .mapInPandas(_verify, "a long, b long")
    near = components(pairs).select(F.col("node").alias("unit"), F.col("root").alias("class_id"))

    # Paragraphs take the class of their component; sentences are their own class.
    named = lines.join(near, "unit", "left").where("n > 1 or class_id is not null") \
        .select(F.lit(0).alias("kind"), "unit", F.coalesce("class_id", "unit").alias("class_id"))
    sentences = rows.where("kind = 1").groupBy("unit").agg(F.count("*").alias("n")).where("n > 1") \
        .select(F.lit(1).alias("kind"), "unit", F.col("unit").alias("class_id"))
    chunks = rows.where("kind = 2").groupBy("unit").agg(F.count("*").alias("n")).where("n > 1") \
        .select(F.lit(2).alias("kind"), "unit", F.col("unit").alias("class_id"))
    repeated = stored(named.unionByName(sentences).unionByName(chunks), "dedup-classes")
    rows = rows.drop("bands")
    members = stored(rows.join(repeated, ["kind", "unit"]).drop("unit").distinct(), "dedup-members")
    facts = members.groupBy("kind", "class_id").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n_units"),
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    units = members.join(facts.where("n_units > 1"), ["kind", "class_id"]).select(
        "doc_id", "kind", "pos", "start", "end", "n_words", "class_id", F.col("first.doc_id").alias("first_doc"),
        (F.col("lo") < F.col("hi")).alias("across"),
        ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))).alias("first"))
    return units.unionByName(reach(src, members))


def passages(found: DataFrame, min_words: int = MIN_PASSAGE) -> DataFrame:
    """Repeated passages: doc_id, kind, start, end, n_words, class_id, first_doc, across, keep.

    Paragraphs are passages; repeated sentences and chunks that no run of repeated
    paragraphs covers are merged, first occurrences and later ones apart. Merged
    spans with less than a sentence's words between them count together for
    ``min_words``. ``keep`` marks first occurrences. Windows span one document's units."""
    lines = found.where("kind = 0")
    out = ["doc_id", "kind", "start", "end", "n_words", "class_id", "first_doc", "across", "keep"]
    place = Window.partitionBy("doc_id").orderBy("start", "end")
    so_far = lambda w: F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = lambda w, n: F.coalesce(F.col("start") - so_far(w) > n, F.lit(True)).cast("int")
    covered = lines.select("doc_id", "start", "end", gap(place, 0).alias("new")) \
        .withColumn("run", F.sum("new").over(place)).groupBy("doc_id", "run") \
        .agg(F.min("start").alias("start"), F.max("end").alias("p_end"))
    events = found.where("kind > 0").withColumn("p_end", F.lit(None).cast("int")).unionByName(
        covered.select("doc_id", "start", F.col("p_end").alias("end"), "p_end", F.lit(0).alias("kind")), allowMissingColumns=True)
    one = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "kind")
    free = events.withColumn("inside", F.coalesce(F.max("p_end").over(one) >= F.col("end"), F.lit(False))) \
        .where("kind > 0 and not inside")
    order = Window.partitionBy("doc_id", "first").orderBy("start", "end", "kind", "class_id")
    near = free.withColumn("new", gap(order, 0)).withColumn("far", gap(order, MIN_SENTENCE - 1)) \
        .withColumn("run", F.sum("new").over(order)).withColumn("group", F.sum("far").over(order))
    runs = near.groupBy("doc_id", "first", "group", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by("class_id", F.struct("start", "kind", "class_id")).alias("class_id"),
        F.min("first_doc").alias("first_doc"), F.max("across").alias("across")) \
        .withColumn("n_words", F.col("end") - F.col("start")).withColumnRenamed("first", "keep")
    joined = runs.withColumn("total", F.sum("n_words").over(Window.partitionBy("doc_id", "keep", "group"))) \
        .where(F.col("total") >= min_words)
    return lines.withColumnRenamed("first", "keep").select(*out).unionByName(
        joined.withColumn("kind", F.lit(1)).select(*out))


def remove(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` without the repeated passages that are not first occurrences."""
    gone = passages(repeated_units(docs, text, ident)).where("not keep")
    spans = gone.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    key, found = fresh(docs.columns, "_id", "_spans")
    held = docs.withColumn(key, F.col(f"`{ident}`").cast("long")).join(
        spans.select(F.col("doc_id").alias(key), F.col("spans").alias(found)), key, "left")
    cut = F.pandas_udf(_without, "string")(F.col(f"`{text}`"), F.to_json(F.col(found)))
    return held.withColumn(text, F.when(F.col(found).isNull(), F.col(f"`{text}`")).otherwise(cut)) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of their spans; what stands between words stays,
    but for one run of it after each removed span."""
    def one(t: str, found: str) -> str:
        if t is None or not found:
            return t
        words = [m.span() for m in _WORD.finditer(t)] + [(len(t), len(t))]
        kept, at = [], 0
        for x in sorted(json.loads(found), key=lambda x: (x["start"], x["end"])):
            if words[x["start"]][0] > at:
                kept.append(t[at:words[x["start"]][0]])
            at = max(at, words[x["end"]][0])
        return "".join(kept) + t[at:]
    return pd.Series([one(t, f) for t, f in zip(text, spans, strict=True)])
