"""O-11 vocabulary, O-13 existence vectors, O-12 substring-containment vectors.

Long sparse form throughout: a vector is rows ``(keys..., term, n)`` for the
non-zero cells only; zero cells are implicit.

Vocabulary (O-11). The reference concatenates each clause's distinct tokens
without de-duplicating across clauses, so a term owns one vector column per
clause it occurs in. We keep one row per term with that ``multiplicity`` and
the positions of its first and last column. All duplicate columns carry the
same values, so statistics need the term once and ranks/budgets use the
multiplicity as a weight.

Containment (O-12): cell (c, t) counts the tokens of clause c that contain t
as a substring. Spark plans a ``contains`` join as a cartesian product, so we
turn the theta join into equi-joins:

1. deal the clauses to chunks of a bounded number of tokens;
2. for every start position of a chunk's distinct words and every length that some term has,
   the hash of the substring is looked up in a bitmap of the terms' hashes (NumPy on Arrow
   columns; the bitmap is of bounded size). What passes is a candidate, once a chunk: nearly
   all of them are terms. Substrings are cut in slices of bounded size, so even a very long
   word is worked through piece by piece;
3. equi-join candidate = term, which decides: a chunk has its distinct terms, with their values;
4. terms and clauses of a chunk meet in one task, which finds the chunk's terms in its distinct
   words again (a bitmap of the chunk's terms, then the terms themselves) and counts per
   (clause, term). A word that contains a term twice still counts once.

Every step is exact: no word or term is capped or skipped. No pair of word and term
is shuffled; a very frequent word ("the" in a third of all clauses) or term comes once a chunk.
``word_term_map`` gives the words' terms by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from clausewise.operators.linear import WHOLE


def distinct_token_rows(token_arrays: DataFrame, keys: Sequence[str], tokens_col: str = "tokens") -> DataFrame:
    """``keys..., dpos, term``: a clause's distinct tokens in first-seen order."""
    return (token_arrays
            .select(*keys, F.posexplode(F.array_distinct(F.col(tokens_col))).alias("dpos", "term"))
            .withColumn("dpos", F.col("dpos").cast("long")))


# Position packing for the first/last column of a term. min/max over a struct
# forces a sort-based aggregate; one DECIMAL(38,0) with the same order keeps
# the (much cheaper) hash aggregate. Layout, 38 digits: doc key + 2^63 (20
# digits), clause number (9 digits), position in the clause (9 digits). A
# clause number or in-clause position is bounded by one row of text, far
# below 10^9.
_DEC = "decimal(38,0)"
_OFFSET = str(2 ** 63)


def _pack(o1: Column, o2: Column, pos: Column) -> Column:
    return ((o1.cast(_DEC) + F.lit(_OFFSET).cast(_DEC)) * F.lit(10 ** 18).cast(_DEC)
            + o2.cast(_DEC) * F.lit(10 ** 9).cast(_DEC) + pos.cast(_DEC))


def _unpack(v: Column) -> tuple[Column, Column, Column]:
    s = F.lpad(v.cast("string"), 38, "0")
    o1 = (F.substring(s, 1, 20).cast(_DEC) - F.lit(_OFFSET).cast(_DEC)).cast("long")
    return o1, F.substring(s, 21, 9).cast("long"), F.substring(s, 30, 9).cast("long")


def vocabulary(token_arrays: DataFrame, scope: Sequence[str], order: Sequence[str],
               tokens_col: str = "tokens") -> DataFrame:
    """O-11: ``scope..., term, multiplicity, first_*, last_*`` (positions in ``order`` + dpos)."""
    rows = distinct_token_rows(token_arrays, [*scope, *order], tokens_col)
    names = [*order, "dpos"]
    if len(order) == 2:
        pos = _pack(F.col(order[0]), F.col(order[1]), F.col("dpos"))
        agg = rows.groupBy(*scope, "term").agg(
            F.count(F.lit(1)).cast("long").alias("multiplicity"),
            F.min(pos).alias("_first"), F.max(pos).alias("_last"))
        cols = [*scope, "term", "multiplicity"]
        for side in ("first", "last"):
            for c, e in zip(names, _unpack(F.col(f"_{side}"))):
                cols.append(e.alias(f"{side}_{'pos' if c == 'dpos' else c}"))
        return agg.select(*cols)
    pos = F.struct(*[F.col(c) for c in order], F.col("dpos"))
    agg = rows.groupBy(*scope, "term").agg(
        F.count(F.lit(1)).cast("long").alias("multiplicity"),
        F.min(pos).alias("_first"), F.max(pos).alias("_last"))
    cols = [*scope, "term", "multiplicity"]
    for side in ("first", "last"):
        for c in names:
            cols.append(F.col(f"_{side}.{c}").alias(f"{side}_{'pos' if c == 'dpos' else c}"))
    return agg.select(*cols)


def existence_vectors(token_arrays: DataFrame, vocab: DataFrame | None, scope: Sequence[str],
                      keys: Sequence[str], tokens_col: str = "tokens") -> DataFrame:
    """O-13: ``scope..., keys..., term, n=1`` where a token equals a vocabulary term.
    ``vocab=None``: the vocabulary was built from these tokens, so all of them do."""
    rows = token_arrays.select(*scope, *keys, F.explode(F.array_distinct(F.col(tokens_col))).alias("term"))
    if vocab is None:
        return rows.withColumn("n", F.lit(1).cast("long"))
    terms = vocab.select(*scope, "term")
    return (rows.join(terms, [*scope, "term"], "left_semi")
            .withColumn("n", F.lit(1).cast("long")))


# Bits of the bitmap of the terms' hashes: about 16 a term, between these limits. More terms let more candidates pass.
LEAST_BITS, MOST_BITS = 2 ** 16, 2 ** 27
# Bytes of the candidates that leave at a time.
SLICE_BYTES = 2 ** 22
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2 ** 64))
_BYTES = np.random.default_rng(1).integers(1, 2 ** 63, 256, np.uint64)
# Tokens of the clauses that one task holds at a time (a single clause may have more).
CHUNK_TOKENS = 2 ** 17


class _Hashed:
    """The strings of an Arrow column as one run of bytes, with hashes of any of their substrings."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).drop_null()
        self.strings = column
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        base, last = int(ends[0]), int(ends[-1])
        data = column.buffers()[2] if len(column) else None
        self.bytes = np.frombuffer(data, np.uint8)[base:last] if data is not None else np.empty(0, np.uint8)
        self.start, self.end = ends[:-1] - base, ends[1:] - base
        power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(self.bytes), x, np.uint64)]))
        self._back = power(_INVERSE)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[self.bytes] * power(_ODD)[:-1])])

    def bit(self, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
        """A number below ``bits`` (a power of two) from the hash of each substring."""
        h = (self._sums[end] - self._sums[start]) * self._back[start]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return (h >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _term_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _Hashed(batch.column(0))
            yield pa.record_batch({"bit": pa.array(t.bit(t.start, t.end, bits) + 1, pa.int64()), "size": pa.array(t.end - t.start, pa.int64())})
    return run


def _found(w: _Hashed, bitmap: np.ndarray, sizes: np.ndarray) -> Iterator[list[tuple[np.ndarray, np.ndarray, int]]]:
    """(begin, word, size) of the words' substrings that stand in the bitmap, in slices of bounded size."""
    bits = len(bitmap) * 8
    whole = np.append((w.bytes & 0xC0) != 0x80, True)  # a character begins here
    at = np.flatnonzero(whole[:-1])
    owner = np.repeat(np.arange(len(w.start)), w.end - w.start)[at]
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    held = 0
    for size in sizes:
        fits = at + size <= w.end[owner]
        at, owner = at[fits], owner[fits]
        if not len(at):
            break
        bit = w.bit(at, at + size, bits)
        hit = ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool) & whole[at + size]
        begin, word = at[hit], owner[hit]
        step = max(1, SLICE_BYTES // int(size))
        for i in range(0, len(begin), step):
            found.append((begin[i:i + step], word[i:i + step], int(size)))
            held += len(found[-1][0]) * int(size)
            if held >= SLICE_BYTES:
                yield found
                found, held = [], 0
    if found:
        yield found


def _strings(w: _Hashed, found: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, pa.Array]:
    """(the word of each substring, the substrings)."""
    begin, word = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    size = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
    ends = np.concatenate([[0], np.cumsum(size)])
    data = w.bytes[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    return word, pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _candidates(bitmap: np.ndarray, sizes: np.ndarray):
    """``word, term``: the substrings of the words that stand in the bitmap, each once a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _Hashed(batch.column(0))
            for found in _found(w, bitmap, sizes):
                yield _slice(w, found)
    return run


def _slice(w: _Hashed, found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    word, strings = _strings(w, found)
    terms = strings.dictionary_encode()
    n = max(1, len(terms.dictionary))
    once = np.sort(word * n + terms.indices.to_numpy())
    once = once[np.diff(once, prepend=-1) > 0]  # a word may hold a term more than once
    return pa.record_batch({"word": w.strings.take(pa.array(once // n)).cast(pa.binary()).cast(pa.string()),
                            "term": terms.dictionary.take(pa.array(once % n))})


def _chunk_candidates(at: Sequence[str], bitmap: np.ndarray, sizes: np.ndarray):
    """``at..., term``: the distinct substrings of a chunk's words that stand in the bitmap."""
    def run(rows: pa.Table) -> pa.Table:
        w = _Hashed(pc.list_flatten(rows["tokens"].combine_chunks()).unique())
        parts = [_strings(w, found)[1].unique() for found in _found(w, bitmap, sizes)]
        terms = pa.chunked_array(parts, pa.string()).unique()
        out = {c: rows[c].combine_chunks().take(pa.array(np.zeros(len(terms), np.int64))) for c in at}
        return pa.table(out | {"term": terms})
    return run


def _contained(words: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, term number) of every word and term in it, once each, in the order of words."""
    w, t = _Hashed(words), _Hashed(terms)
    size = t.end - t.start
    bits = max(LEAST_BITS, 2 ** (16 * len(size)).bit_length())
    on = np.zeros(bits, bool)
    on[t.bit(t.start, t.end, bits)] = True
    n, keys = max(1, len(terms)), [np.empty(0, np.int64)]
    for found in _found(w, np.packbits(on, bitorder="little"), np.unique(size[size > 0])):
        word, strings = _strings(w, found)
        term = pc.fill_null(pc.index_in(strings, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        keys.append((word * n + term)[term >= 0])
    key = np.sort(np.concatenate(keys))
    key = key[np.diff(key, prepend=-1) > 0]
    return key // n, key % n


def _bitmap(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(the bitmap of the terms' hashes, the terms' lengths in bytes, ascending)."""
    n = terms.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 2 ** (16 * n).bit_length()))
    hashed = terms.mapInArrow(_term_bits(bits), "bit long, size long")
    rows = hashed.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("part"), F.collect_set("size").alias("sizes")).collect()
    parts = max(1, bits // 2 ** 15)
    out, sizes = np.zeros(parts * 2 ** 12, np.uint8), set()
    for r in rows:
        at = (r["bucket"] - 1) * 2 ** 12
        out[at:at + len(r["part"])] = np.frombuffer(bytes(r["part"]), np.uint8)
        sizes.update(r["sizes"])
    return out, np.array(sorted(x for x in sizes if x > 0), np.int64)


def word_term_map(words: DataFrame, vocab: DataFrame, scope: Sequence[str] = (), fields: Sequence[str] = ()) -> DataFrame:
    """``word, scope..., terms ARRAY<STRING>``: the scope's terms each word contains; with
    ``fields`` (further columns of ``vocab``) an array of structs ``term, fields...``.

    ``words`` has one column ``word`` (distinct); ``vocab`` has ``scope..., term``
    (distinct per scope). The scope is resolved here, on the distinct-word
    side, so the much larger token/cell side needs no semi-join per scope.
    (Carrying a scope set per term and filtering inside each token row was
    measured slower: the per-row arrays of structs cost more than the
    per-scope rows of this map.)
    """
    bitmap, sizes = _bitmap(vocab.select("term").distinct() if scope else vocab.select("term"))
    # The distinct words are small on disk but each becomes several
    # candidates; AQE sizes partitions by input bytes and would put them all
    # in one task. An explicit round-robin to the configured shuffle width
    # (which AQE does not coalesce) spreads the expansion over the cluster.
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = words.repartition(width).mapInArrow(_candidates(bitmap, sizes), "word string, term string")
    matched = candidates.join(vocab.select(*scope, "term", *fields), "term")
    entry = F.struct("term", *fields) if fields else F.col("term")
    return matched.groupBy("word", *scope).agg(F.collect_set(entry).alias("terms"))


def _lists(token_rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep..., tokens``: token arrays as they are, single (counted) words as short arrays."""
    if "tokens" in token_rows.columns:
        return token_rows.select(*keep, "tokens")
    words = F.array_repeat("word", F.col("k").cast("int")) if "k" in token_rows.columns else F.array("word")
    return token_rows.where(F.col("word").isNotNull()).select(*keep, words.alias("tokens"))


def in_chunks(token_rows: DataFrame, lookup: Callable[[DataFrame], DataFrame], scope: Sequence[str], group: Sequence[str],
              chunk_tokens: int = CHUNK_TOKENS, together: Sequence[str] = ()) -> PandasCogroupedOps:
    """The clauses (``group..., tokens``) in chunks of about ``chunk_tokens`` tokens, cogrouped with
    what ``lookup`` makes of the chunks (``scope..., chunk`` and more). Clauses of
    equal ``group`` columns (``together``: of equal such columns) are in one chunk."""
    rows = _lists(token_rows, group)
    for c in scope:
        rows = rows.where(F.col(c).isNotNull())  # such a clause has no vocabulary
    width = int(token_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(F.greatest(F.size("tokens"), F.lit(0)).cast("long"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64(*(together or group)), F.lit(max(1, -(-total // chunk_tokens)))).alias("chunk")
    at = [*scope, "chunk"]
    rows = rows.select(*group, "tokens", chunk).repartition(width, *at)
    right = lookup(rows)
    left = rows.select(*[F.col(c).alias(c) for c in (*group, "tokens", "chunk")])  # new columns: both sides come from one frame
    return left.groupBy(*at).cogroup(right.groupBy(*at))


def chunk_words(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``scope..., chunk, word``: the distinct words of each chunk, for a ``lookup`` by word."""
    words = rows.select(*scope, "chunk", F.explode("tokens").alias("word")).groupBy(*scope, "chunk", "word").agg(F.lit(1).alias("_"))
    return words.select(*scope, "chunk", "word")


def _fetched(vocab: DataFrame, scope: Sequence[str], fields: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """``scope..., chunk, term, fields...``: the terms that a chunk's words contain, once a chunk."""
    bitmap, sizes = _bitmap(vocab.select("term").distinct() if scope else vocab.select("term"))
    at = [*scope, "chunk"]

    def lookup(rows: DataFrame) -> DataFrame:
        made = rows.groupBy(*at).applyInArrow(_chunk_candidates(at, bitmap, sizes), f"{ddl(rows, at)}, term string")
        return made.join(vocab.select(*scope, "term", *fields), [*scope, "term"]).select(*at, "term", *fields)
    return lookup


def unit_numbers(left: pa.Table, group: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the row's unit, a row of every unit): rows of equal ``group`` columns are one unit."""
    code = np.zeros(len(left), np.int64)
    for c in group:
        col = left[c].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * len(col.dictionary) + col.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]  # numbers below the number of rows: products stay small
    _, first, unit = np.unique(code, return_index=True, return_inverse=True)
    return unit, first


def _chunk_cells(left: pa.Table, right: pa.Table, group: Sequence[str]):
    """A chunk's cells: (a row of each unit, the cell's unit, its row of ``right``, n)."""
    unit, first = unit_numbers(left, group)
    tokens = left["tokens"].combine_chunks()
    words = pc.list_flatten(tokens).dictionary_encode()
    word, term = _contained(words.dictionary, right["term"].combine_chunks())
    length = np.bincount(word, minlength=len(words.dictionary))
    start = np.cumsum(length) - length
    word = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False)
    owner = unit[pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)]
    owner, word = owner[word >= 0], word[word >= 0]
    length = length[word]
    post = np.repeat(start[word] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    n_terms = max(1, len(right))
    key = np.repeat(owner, length) * n_terms + term[post]
    key.sort()
    head = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(head, append=len(key))
    return first, key[head] // n_terms, key[head] % n_terms, n


def _cell_rows(group: Sequence[str], fields: Sequence[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first, unit, term, n = _chunk_cells(left, right, group)
        rows = left.select(list(group)).take(pa.array(first[unit]))
        for name in ("term", *fields):
            rows = rows.append_column(name, right[name].combine_chunks().take(pa.array(term)))
        return rows.append_column("n", pa.array(n, pa.int64()))
    return run


def _sum_rows(scope: Sequence[str], group: Sequence[str], labels: Sequence[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first, unit, term, n = _chunk_cells(left, right, group)
        # sums of a chunk are far below 2^53, where doubles are exact
        count = lambda w: pa.array(np.bincount(term, weights=w, minlength=len(right)).astype(np.int64))
        out = {c: left[c].combine_chunks().take(pa.array(np.zeros(len(right), np.int64))) for c in scope} | {"term": right["term"].combine_chunks()}
        out |= {"total": count(n), "q": count(n.astype(np.float64) * n)}
        for x in labels:
            one = pc.fill_null(pc.equal(left[x].combine_chunks(), 1), False).to_numpy(zero_copy_only=False)
            out[f"s1_{x}"] = count(n * one[first[unit]])
        return pa.table(out)
    return run


def ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def containment_vectors(token_rows: DataFrame, vocab: DataFrame, scope: Sequence[str],
                        keys: Sequence[str], carry: Sequence[str] = (),
                        vocab_from_same_tokens: bool = False, values: DataFrame | None = None,
                        chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """O-12: ``scope..., keys..., carry..., term, n``.

    ``token_rows`` holds one row per clause (``scope, keys, carry, tokens``), per token
    (``word``) or per counted word (``word`` with ``k``);
    ``carry`` columns are functionally dependent on ``keys`` (e.g. the class)
    and ride along so later statistics need no join back.

    ``vocab_from_same_tokens``: says that the vocabulary was built from these very
    tokens (training); the rows and the work are the same either way.

    ``values``: ``scope..., term`` (the vocabulary's) and further columns of a term, which come
    with the chunk's terms (far fewer than cells) and come out beside the term.

    Shuffles: clauses are dealt to chunks of a bounded number of tokens; a chunk's
    distinct terms are fetched, and terms and clauses
    meet in one task per chunk, whose cells need no further exchange.
    """
    group = [*scope, *keys, *carry]
    fields = [] if values is None else [c for c in values.columns if c not in (*scope, "term")]
    lookup = _fetched(vocab if values is None else values, scope, fields)
    extra = f", {ddl(values, fields)}" if values is not None else ""
    schema = f"{ddl(token_rows, group)}, term string{extra}, n long"
    return in_chunks(token_rows, lookup, scope, group, chunk_tokens).applyInArrow(_cell_rows(group, fields), schema)


def containment_sums(token_rows: DataFrame, vocab: DataFrame, scope: Sequence[str], keys: Sequence[str], labels: Sequence[str] = (),
                     vocab_from_same_tokens: bool = False, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``scope..., term, total, q, s1_<label>...``: ``stats.label_sums`` of the containment
    vectors, whose cells are summed in their chunk and never leave it."""
    sums = ["total", "q", *[f"s1_{x}" for x in labels]]
    group = [*scope, *keys, *labels]
    schema = "".join(f"{ddl(token_rows, [c])}, " for c in scope) + "term string, " + ", ".join(f"`{c}` long" for c in sums)
    part = in_chunks(token_rows, _fetched(vocab, scope), scope, group, chunk_tokens).applyInArrow(_sum_rows(scope, group, labels), schema)
    return part.groupBy(*scope, "term").agg(*[F.sum(c).cast("long").alias(c) for c in sums])


def _margin_rows(group: Sequence[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first, unit, term, n = _chunk_cells(left, right, group)
        weight = right["weight"].combine_chunks().to_numpy(zero_copy_only=False)[term]
        head = np.flatnonzero(np.diff(unit, prepend=-1))  # cells are in the order of units
        out = left.select(list(group)).take(pa.array(first[unit[head]]))
        return out.append_column("margin", pa.array(np.add.reduceat(n * weight, head) if len(head) else weight))
    return run


def containment_margins(token_rows: DataFrame, weights: DataFrame, scope: Sequence[str], keys: Sequence[str],
                        chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``scope..., keys..., margin``: sum of n * weight over a clause's cells (``weights``: ``scope..., term,
    weight``, a term once a scope and not null), which never leave their chunk. Clauses without a cell have no row."""
    group = [*scope, *keys]
    schema = f"{ddl(token_rows, group)}, margin {weights.schema['weight'].dataType.simpleString()}"
    return in_chunks(token_rows, _fetched(weights, scope, ["weight"]), scope, group, chunk_tokens).applyInArrow(_margin_rows(group), schema)


def _refit_rows(doc: Sequence[str], clause: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = [*doc, clause]
        first, unit, term, n = _chunk_cells(left, right, group)
        weight = right["weight"].combine_chunks().to_numpy(zero_copy_only=False)
        row_doc, doc_first = unit_numbers(left, doc)
        size = np.bincount(row_doc, minlength=len(doc_first))
        owner = row_doc[first[unit]]
        pair, at = np.unique(owner * max(1, len(right)) + term, return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        square = np.zeros(len(pair), np.int64)
        np.add.at(total, at, n)
        np.add.at(square, at, n * n)
        pair_doc, units = pair // max(1, len(right)), size[pair // max(1, len(right))]
        spread = units * square - total * total  # counts of one text: far below 2^63
        std = np.where(spread == 0, 1.0, np.sqrt(spread.astype(np.float64)) / units)
        v = weight[pair % max(1, len(right))] / std
        own = np.bincount(unit, weights=v[at] * n, minlength=len(first))
        has = np.bincount(unit, minlength=len(first)) > 0
        whole = np.bincount(pair_doc, weights=-v * (total / units), minlength=len(doc_first))
        some = np.bincount(pair_doc, minlength=len(doc_first)) > 0
        clauses = left.select(group).take(pa.array(first[has])).append_column("margin", pa.array(own[has], pa.float64()))
        docs = left.select(list(doc)).take(pa.array(doc_first[some]))
        docs = docs.append_column(clause, pa.array(np.full(len(docs), WHOLE), pa.int64())).append_column("margin", pa.array(whole[some], pa.float64()))
        return pa.concat_tables([clauses, docs.cast(clauses.schema)])
    return run


def refit_containment_margins(token_rows: DataFrame, weights: DataFrame, scope: Sequence[str], doc: str, clause: str,
                              chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``linear.refit_margins`` of the containment counts: a document's clauses are in one chunk, so its
    means and deviations are made there and no cell leaves."""
    group = [*scope, doc, clause]
    schema = f"{ddl(token_rows, group)}, margin double"
    return in_chunks(token_rows, _fetched(weights, scope, ["weight"]), scope, group, chunk_tokens, [*scope, doc]) \
        .applyInArrow(_refit_rows([*scope, doc], clause), schema)


def _counted(keep: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("_tokens")
            words = pc.list_flatten(tokens).dictionary_encode()
            n = max(1, len(words.dictionary))
            word = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
            key, k = np.unique((row * n + word)[word >= 0], return_counts=True)
            at = pa.array(key // n)
            out = {f"_{i}": batch.column(c).take(at) for i, c in enumerate(keep)}
            yield pa.record_batch(out | {"_word": words.dictionary.take(pa.array(key % n)), "_k": pa.array(k, pa.int64())})
    return run


def counted_words(token_arrays: DataFrame, keep: Sequence[str], tokens_col: str = "tokens") -> DataFrame:
    """``keep..., word, k``: a clause's words with their counts, from the array in
    its row (NumPy on Arrow columns), without a shuffle."""
    rows = token_arrays.select(*keep, F.col(tokens_col).alias("_tokens"))
    kinds = "".join(f"_{i} {rows.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return rows.mapInArrow(_counted(keep), f"{kinds}_word string, _k long").toDF(*keep, "word", "k")
