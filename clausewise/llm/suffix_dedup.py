"""Removal of every byte covered by a string of ``LENGTH`` bytes that occurs twice.

Suffix arrays of the collection are built column by column: in round r the
suffixes of r bytes of all texts of a collection enter its Burrows-Wheeler
transform at once, one symbol a text. Their places follow from the ranks of the
last round's symbols, and the common prefix with either neighbour is one more than
the least common prefix between the two places of the round before. Transform and
common prefixes lie in sequential files, of which a round reads one and writes the
other. A string occurs twice where a common prefix reaches ``LENGTH``.

What makes collections of bounded size: all windows of ``LENGTH`` bytes that share
the smallest hash of their substrings (the *anchor*) form a *piece*, a stretch of
text; equal windows have equal anchors. So

1. anchors are counted; those of one piece are done;
2. pieces with a repeated anchor are counted by digest; equal pieces are one text with a
   number, and an anchor with a single text needs no suffix array;
3. the distinct texts of the other anchors are dealt to collections by anchor, where
   the anchor itself, which all windows of its texts hold, becomes a short number;
   anchors whose texts all occur twice as a whole are done;
4. an anchor with more than ``GROUP`` distinct texts (a passage in very many hosts) is
   cut again: its texts are treated as documents with longer substrings as anchors,
   at last with whole windows, whose groups are single texts;
5. the marked pieces meet their documents again in chunks of about ``CHUNK`` bytes.

Tasks know the repeated anchors from a table of ``FILTER_BITS`` bits, whatever the
corpus; a chance hit costs a row, never a result. The files lie in the task's own
scratch folder and die with it; Spark repeats a lost task from stored tables.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` stay; equal rows are
copies of each other, rows with null or repeated ids stand for themselves; long texts
are cut in overlapping strips, so that no window is lost; an empty table gives no
row; extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored

LENGTH = 200
SPANS = (96, 24, 1)  # substrings a window is anchored among, level by level
GROUP = 4096  # distinct texts of an anchor in one collection
COLLECTION = 130_000  # bytes of a collection, about
CHUNK = 8_000_000  # bytes of documents that meet their marks in one task
STRIP = 100_000  # bytes cut into pieces at a time
FILTER_BITS = 2 ** 26
SEEN = 200_000  # pieces a task remembers having emitted

# Bytes that never stand in UTF-8: one before the start of a text, twelve as digits.
_TERM = 0xFF
_DIGITS = bytes([0xC0, 0xC1, *range(0xF5, 0xFF)])
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE, _LOW = 0x9E3779B97F4A7C15 | 5, np.uint64(0xFF)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Cutter:
    """Cuts strips of documents into pieces."""

    def __init__(self, length: int, span: int):
        self.length, self.span, self.width = length, span, length - span + 1
        self.up = self.down = np.empty(0, np.uint64)

    def strips(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """(document, offset in it, offset in the buffer, buffer) of strips of about STRIP bytes."""
        doc, base, parts, size = [], [], [], 0
        for d, text in enumerate(texts):
            at = 0
            while len(text) - at >= self.length:
                part = text if at == 0 and len(text) <= STRIP else text[at:at + STRIP + self.length - 1]
                doc.append(d)
                base.append(at)
                parts.append(part)
                size, at = size + len(part), at + STRIP
                if size >= STRIP:
                    yield np.array(doc), np.array(base), np.cumsum([0, *map(len, parts)]), b"".join(parts)
                    doc, base, parts, size = [], [], [], 0
        if parts:
            yield np.array(doc), np.array(base), np.cumsum([0, *map(len, parts)]), b"".join(parts)

    def pieces(self, base: np.ndarray, offset: np.ndarray, buffer: bytes):
        """(strip, first window, number of windows, anchor, whether the anchor stands
        in it twice, the anchor's offset in it) of the pieces, in order. Of equal hashes the place in the document
        decides, so that a document is cut alike in whatever buffer it lies."""
        x, n = np.frombuffer(buffer, np.uint8), len(buffer)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2 ** 64), n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[x] * self.up[:n], out=total[1:])
        m = n - self.width + 1
        h = (total[self.width:] - total[:m]) * self.down[:m]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low = (np.arange(n) + np.repeat(base - offset[:-1], np.diff(offset)))[:m].astype(np.uint64) & _LOW
        h &= ~_LOW
        first, last = h | low, h | (_LOW - low)
        wide = 1
        while wide < self.span:  # the smallest of ``wide`` in a row
            step = min(wide, self.span - wide)
            first, last = np.minimum(first[:-step], first[step:]), np.minimum(last[:-step], last[step:])
            wide += step
        inside = np.zeros(len(first) + 1, bool)
        for a, b in zip(offset[:-1], offset[1:], strict=True):
            inside[a:b - self.length + 1] = True
        cut = np.ones(len(first) + 1, bool)
        cut[1:-1] = first[1:] != first[:-1]
        cut[1:] |= inside[1:] != inside[:-1]
        cut[offset[:-1]] = True
        start = np.flatnonzero(cut)
        count = np.diff(start)
        start = start[:-1]
        keep = inside[start]
        start, count = start[keep], count[keep]
        tie = (first.view(np.uint8)[::8] + last.view(np.uint8)[::8]) != 255
        ties = np.concatenate([[0], np.cumsum(tie)])
        twice = ties[start + count] > ties[start]
        strip = np.searchsorted(offset, start, "right") - 1
        at = ((first[start] & _LOW).astype(np.int64) - (start - offset[strip] + base[strip])) & 255
        return strip, start, count, (first[start] >> np.uint64(8)).view(np.int64), twice, at


def _digest(buffer: bytes, start: int, end: int) -> bytes:
    return xxhash.xxh3_128_digest(buffer[start:end])


def _has_bit(table: np.ndarray | None, anchors: np.ndarray) -> np.ndarray:
    if table is None:
        return np.ones(len(anchors), bool)
    bit = anchors.view(np.uint64) % np.uint64(len(table) * 8)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").to_pylist()


def _slices(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lens = batch.column("text")
        ends = np.frombuffer(lens.buffers()[1], np.int32, count=len(lens) + 1, offset=4 * lens.offset)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + 40 * STRIP, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _anchors(cutter: Cutter):
    def run(batches):
        for batch in _slices(batches):
            for _, base, offset, buffer in cutter.strips(_texts(batch)):
                _, _, _, anchor, twice, _ = cutter.pieces(base, offset, buffer)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(twice + 1, pa.int64())], ["anchor", "n"])
    return run


def _occurrences(cutter: Cutter, table: np.ndarray):
    def run(batches):
        for batch in _slices(batches):
            chunk = batch.column("chunk").to_numpy()
            for doc, base, offset, buffer in cutter.strips(_texts(batch)):
                strip, start, count, anchor, twice, _ = cutter.pieces(base, offset, buffer)
                use = np.flatnonzero(_has_bit(table, anchor))
                ends = start[use] + count[use] + cutter.length - 1
                digests = [_digest(buffer, a, b) for a, b in zip(start[use].tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk[doc[strip[use]]]), pa.array(anchor[use]), pa.array(digests, pa.binary()), pa.array(twice[use])],
                    ["chunk", "anchor", "piece", "twice"])
    return run


def _piece_texts(cutter: Cutter, table: np.ndarray):
    def run(batches):
        seen: set[bytes] = set()
        for batch in _slices(batches):
            for _, base, offset, buffer in cutter.strips(_texts(batch)):
                _, *found = cutter.pieces(base, offset, buffer)
                use = np.flatnonzero(_has_bit(table, found[2]))
                out = []
                for a, n, key, two, at in zip(*(v[use].tolist() for v in found), strict=True):
                    text = buffer[a:a + n + cutter.length - 1]
                    piece = xxhash.xxh3_128_digest(text)
                    if piece not in seen:
                        seen.add(piece)
                        out.append((key, piece, two, at, text))
                if len(seen) > SEEN:
                    seen.clear()
                if out:
                    kinds = pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                     ["anchor", "piece", "twice", "at", "text"])
    return run


def bit_table(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The bits of the anchors in ``keys``: ``bits`` / 8 bytes, however many there are."""
    at = F.pmod(F.col("anchor"), F.lit(bits))
    cells = keys.groupBy(F.shiftright(at, 5).alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(anchor, {bits}) & 31 as int))")).alias("bit")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[cells["cell"].to_numpy()] = cells["bit"].to_numpy().astype(np.uint32)
    return table.view(np.uint8)


# --- one collection -----------------------------------------------------------

class _Records:
    """One 16-bit record a suffix (symbol before it, common prefix) in sequential
    files: a round reads one from its start to its end and writes the other."""

    def __init__(self, folder: str):
        self.now, self.next = (open(f"{folder}/{name}", "w+b", buffering=0) for name in ("now", "next"))
        self.size = 0

    def read(self) -> np.ndarray:
        self.now.seek(0)
        return np.fromfile(self.now, np.uint16, self.size)

    def write(self, records: np.ndarray) -> None:
        self.next.seek(0)
        self.next.write(records.data)
        self.now, self.next, self.size = self.next, self.now, len(records)

    def close(self) -> None:
        self.now.close()
        self.next.close()


def transform(texts: list[bytes], cap: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of ``texts`` (0xFF before a text's start) and the
    common prefix, at most ``cap`` <= 250, of each suffix with the one before it.
    The first ``len(texts)`` suffixes are the empty ones, in the texts' order."""
    m = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    whole, begin = np.frombuffer(b"".join(texts) + b"\0", np.uint8), np.cumsum(size) - size
    before = lambda who, r: np.where(size[who] > r, whole[np.maximum(begin[who] + size[who] - r - 1, 0)], _TERM)
    records = _Records(folder)
    who = pos = np.arange(m)
    count = np.zeros(256, np.int64)
    entered = before(who, 0).astype(np.uint16)
    records.write(entered)
    for r in range(1, int(size.max(initial=0)) + 1):
        rows = records.read()
        n = len(rows)
        bwt, lcp = rows.astype(np.uint8), np.empty(n + 3, np.uint8)
        lcp[:n], lcp[n:] = rows >> 8, 255
        going = size[who] >= r
        who, pos = who[going], pos[going]  # in the order of pos
        c = bwt[pos]
        count += np.bincount(entered, minlength=256)
        first = np.concatenate([[0], np.cumsum(count)])
        places = np.argsort(bwt, kind="stable")  # where each symbol stands, symbol by symbol
        rank = np.searchsorted(places + np.repeat(np.arange(256) * n, count), pos + c.astype(np.int64) * n)
        has_left, has_right = rank > first[c], rank + 1 < first[c.astype(np.int64) + 1]
        up = _least(lcp, np.where(has_left, places[np.maximum(rank - 1, 0)] + 1, pos), pos + 1)
        down = _least(lcp, pos + 1, np.where(has_right, places[np.minimum(rank + 1, n - 1)] + 1, pos + 2))
        up, down = (np.where(has, np.minimum(x.astype(np.int64) + 1, cap), 0) << 8 for has, x in ((has_left, up), (has_right, down)))
        new = m + rank
        order = np.argsort(new, kind="stable")
        who, pos, follows = who[order], new[order], has_right[order]
        old = np.ones(n + len(pos), bool)
        old[pos] = False
        out = np.empty(len(old), np.uint16)
        out[old] = rows
        entered = before(who, r)
        out[pos] = entered | up[order]
        after = pos[follows] + 1
        out[after] = out[after] & 255 | down[order][follows]
        records.write(out)
    rows = records.read()
    records.close()
    return rows.astype(np.uint8), (rows >> 8).astype(np.uint8)


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of each values[start:end], start < end < len(values); ``start`` or ``end`` ascending."""
    pairs = np.empty(2 * len(start), np.int64)
    pairs[::2], pairs[1::2] = start, end
    return np.minimum.reduceat(values, pairs)[::2] if len(start) else values[:0]


def repeated_windows(texts: list[bytes], length: int, folder: str) -> list[list[int]]:
    """For each text, the starts of its windows of ``length`` bytes that occur
    twice in the collection, ascending."""
    bwt, lcp = transform(texts, length, folder)
    m = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    places = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[places] = m + np.arange(len(bwt))
    marked = lcp >= length
    marked[:-1] |= marked[1:]
    out: list[list[int]] = [[] for _ in texts]
    who = pos = np.arange(m)
    for r in range(1, int(size.max(initial=0)) + 1):
        going = size[who] >= r
        who, pos = who[going], step[pos[going]]
        if r >= length:
            for j in who[marked[pos]].tolist():
                out[j].append(int(size[j]) - r)
    return [starts[::-1] for starts in out]


def _runs(starts: list[int]) -> list[int]:
    """Ascending numbers as runs: first, last, first, last, .."""
    s = np.array(starts, np.int64)
    cut = np.flatnonzero(np.diff(s) != 1)
    return np.stack([s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]]], 1).ravel().tolist()


def numbered(anchors: list[bytes]) -> list[bytes]:
    """A number for each distinct anchor, in digits that stand in no text."""
    number = {a: i for i, a in enumerate(dict.fromkeys(anchors))}
    width = 1
    while len(_DIGITS) ** width < len(number):
        width += 1
    digits = {a: bytes(_DIGITS[i // len(_DIGITS) ** k % len(_DIGITS)] for k in range(width)) for a, i in number.items()}
    return [digits[a] for a in anchors]


def _collection(length: int, span: int):
    width = length - span + 1

    def marked(rows: pd.DataFrame, texts: list[bytes], length: int):
        with tempfile.TemporaryDirectory(prefix="suffix-dedup-") as folder:
            for piece, starts in zip(rows["piece"], repeated_windows(texts, length, folder), strict=True):
                if starts:
                    yield piece, _runs(starts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = ~pdf["anchor"].duplicated(keep=False)
        pdf = pdf[~(alone & ~pdf["twice"])].sort_values(["anchor", "piece"])  # chance hits have no partner
        # Where an anchor stands twice in a window, it has no place of its own: such texts stay as they are.
        plain = pdf["anchor"].isin(pdf.loc[pdf["twice"], "anchor"])
        out = []
        if plain.any():
            out += marked(pdf[plain], pdf.loc[plain, "text"].tolist(), length)
        if not plain.all():
            rows = pdf[~plain]
            parts = [(t[:at], t[at:at + width], t[at + width:]) for t, at in zip(rows["text"], rows["at"], strict=True)]
            numbers = numbered([anchor for _, anchor, _ in parts])
            short = [left + n + right for (left, _, right), n in zip(parts, numbers, strict=True)]
            out += marked(rows, short, length - width + len(numbers[0]))
        return pd.DataFrame(out, columns=["piece", "runs"])
    return run


# --- the corpus -----------------------------------------------------------------

def _window_runs(cutter: Cutter, texts: list[bytes], marks: dict[bytes, list[int] | None], table: np.ndarray) -> list[list[int]]:
    """For each text, its marked windows as runs first, last, first, last, .. in
    ascending order. ``marks`` has the runs of marked pieces, None for all windows."""
    out: list[list[int]] = [[] for _ in texts]
    for doc, base, offset, buffer in cutter.strips(texts):
        strip, start, count, anchor, _, _ = cutter.pieces(base, offset, buffer)
        use = np.flatnonzero(_has_bit(table, anchor))
        shift = base[strip] - offset[strip]
        for d, a, n, by in zip(doc[strip[use]].tolist(), start[use].tolist(), count[use].tolist(), shift[use].tolist(), strict=True):
            piece = _digest(buffer, a, a + n + cutter.length - 1)
            if piece in marks:
                runs = marks[piece]
                out[d] += (a + by, a + by + n - 1) if runs is None else [x + a + by for x in runs]
    return out


def _marks(table: pa.Table) -> dict[bytes, list[int] | None]:
    marks: dict[bytes, list[int] | None] = {}
    for piece, runs in zip(table.column("piece").to_pylist(), table.column("runs").to_pylist(), strict=True):
        marks[piece] = None if runs is None or (piece in marks and marks[piece] is None) else runs
    return marks


def marked_pieces(texts: DataFrame, length: int, spans: tuple[int, ...], group: int) -> tuple[DataFrame, Cutter, np.ndarray]:
    """(chunk, piece, runs) for the pieces of ``texts`` (chunk int, text binary)
    that hold windows occurring twice, and what cuts and filters those pieces."""
    cutter = Cutter(length, spans[0])
    anchors = texts.mapInArrow(_anchors(cutter), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    table = bit_table(anchors.where("n > 1"))
    found = stored(texts.mapInArrow(_occurrences(cutter, table), "chunk int, anchor long, piece binary, twice boolean")
                   .groupBy("anchor", "piece", "chunk").agg(F.count("*").alias("n"), F.max("twice").alias("twice")), "suffix-found")
    pieces = stored(found.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.max("twice").alias("twice")), "suffix-pieces")
    groups = stored(pieces.groupBy("anchor").agg(F.count("*").alias("texts"), F.max("twice").alias("twice"), F.min("n").alias("n"))
                    .where("(texts > 1 or twice) and n = 1"), "suffix-groups")
    hot = F.lit(False) if len(spans) == 1 else F.col("texts") > group
    marks = pieces.where("n > 1").select("piece", F.lit(None).cast("array<int>").alias("runs"))

    parts = "anchor long, piece binary, twice boolean, at int, text binary"
    bodies = lambda keys: texts.mapInArrow(_piece_texts(cutter, bit_table(keys)), parts).dropDuplicates(["anchor", "piece"])
    cold = stored(bodies(groups.where(~hot)), "suffix-texts")
    size = cold.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size:
        n = -(-size // COLLECTION)
        tasks = min(n, 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = cold.withColumn("collection", F.pmod(F.xxhash64("anchor"), F.lit(n))).repartition(tasks, "collection")
        marks = marks.unionByName(dealt.groupBy("collection").applyInPandas(_collection(length, spans[0]), "piece binary, runs array<int>"))
    if not groups.where(hot).isEmpty():
        inner = stored(bodies(groups.where(hot)).select("piece", "text"), "suffix-hot")
        inner = in_chunks(inner, inner.agg(F.sum(F.octet_length("text"))).first()[0], "piece")
        marks = marks.unionByName(marked_texts(inner, length, spans[1:], group, _as_marks, "piece binary, runs array<int>"))
    return found.select("chunk", "piece").join(marks, "piece"), cutter, table


def in_chunks(texts: DataFrame, size: int | None, key: str) -> DataFrame:
    n = max(1, -(-(size or 0) // CHUNK))
    return texts.withColumn("chunk", F.pmod(F.xxhash64(key, "text"), F.lit(n)).cast("int"))


def marked_texts(texts: DataFrame, length: int, spans: tuple[int, ...], group: int, result, schema: str) -> DataFrame:
    """``result(table, window runs of its texts)`` of each chunk of ``texts``, as rows of ``schema``."""
    marks, cutter, table = marked_pieces(texts, length, spans, group)

    def meet(mine: pa.Table, found: pa.Table) -> pa.Table:
        return result(mine, _window_runs(cutter, mine.column("text").to_pylist(), _marks(found), table))

    return texts.groupBy("chunk").cogroup(marks.select("chunk", "piece", "runs").groupBy("chunk")).applyInArrow(meet, schema)


def _as_marks(mine: pa.Table, runs: list[list[int]]) -> pa.Table:
    keep = [i for i, r in enumerate(runs) if r]
    return pa.table({"piece": mine.column("piece").take(pa.array(keep, pa.int64())),
                     "runs": pa.array([runs[i] for i in keep], pa.list_(pa.int32()))})


def covered(runs: list[int], length: int) -> list[tuple[int, int]]:
    """The maximal stretches of bytes that runs of windows cover."""
    if not runs:
        return []
    start, end = np.array(runs[::2]), np.array(runs[1::2]) + length
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist(), strict=True))


def _without(length: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def result(mine: pa.Table, runs: list[list[int]]) -> pa.Table:
        spans, kept = [], []
        for text, r in zip(mine.column("text").to_pylist(), runs, strict=True):
            gone = covered(r, length)
            spans.append([{"start": a, "end": b} for a, b in gone])
            borders = [0, *(x for s in gone for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)))
        return pa.table({"id": mine.column("id"), "n_bytes": pa.array([len(t) for t in mine.column("text").to_pylist()], pa.int64()),
                         "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})
    return result


def remove(docs: DataFrame, length: int = LENGTH, spans: tuple[int, ...] = SPANS, group: int = GROUP,
           ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) of every document: the stretches of bytes covered by
    strings of ``length`` bytes that occur twice in the corpus, and the bytes left. ``length`` is at most
    250, ``spans`` are below it and below 256, the last of them 1."""
    rows = docs.select(F.col(f"`{ident}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    rows = in_chunks(rows, rows.agg(F.sum(F.octet_length("text"))).first()[0], "id")
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return marked_texts(rows, length, spans, group, _without(length), schema).withColumnRenamed("id", ident)
