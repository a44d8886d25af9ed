"""O-06 with versions: base and deltas equal one build; half-written versions do not exist."""

import os
import random

import pytest
from pyspark.sql import functions as F

from clausewise.operators.increments import Book
from clausewise.operators.stats import label_sums
from clausewise.operators.vocab import containment_vectors, counted_words, vocabulary

KEYS, LABELS = ["d", "c"], ["y"]
WORDS = ["a", "ab", "abc", "xabcx", "bc", "Q", "zz", "zzz", "bcx", "[CLS]", "é"]


def units(spark, seed, docs):
    rng = random.Random(seed)
    rows = [(d, c, [rng.choice(WORDS) for _ in range(rng.randrange(7))], rng.randrange(2)) for d in docs for c in range(3)]
    return spark.createDataFrame(rows, "d long, c long, tokens array<string>, y int")


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_versions_equal_one_build(spark, scratch):
    book, whole = Book(spark, scratch, KEYS, LABELS), None
    for v, docs in enumerate(([5, 9], [1, 7, 20], [], [3]), 1):
        delta = units(spark, v, docs)
        assert book.add(delta) == v
        whole = delta if whole is None else whole.unionByName(delta)
        vocab = vocabulary(whole, [], KEYS)
        cells = containment_vectors(counted_words(whole, [*KEYS, *LABELS]), vocab, [], KEYS, carry=LABELS)
        assert rows(book.vocabulary()) == rows(vocab)
        assert rows(book.sums()) == rows(label_sums(cells, [], LABELS))
        assert book.sizes().first().n_units == whole.count()
        assert {r.term for r in book.dictionary().collect()} == {w.lower() for r in whole.collect() for w in r.tokens} - {"[cls]"}
    first = {r.term: r.id for r in book.dictionary(1).collect()}
    last = {r.term: r.id for r in book.dictionary().collect()}
    assert all(last[t] == i for t, i in first.items())  # ids are stable
    assert sorted(last.values()) == list(range(4, 4 + len(last))) and book.next_id() == 4 + len(last)
    assert rows(book.vocabulary(1)) == rows(vocabulary(units(spark, 1, [5, 9]), [], KEYS))


def test_new_terms_reach_old_clauses(spark, scratch):
    make = lambda r: spark.createDataFrame(r, "d long, c long, tokens array<string>, y int")
    book = Book(spark, scratch, KEYS, LABELS)
    book.add(make([(1, 0, ["xabcx", "abc"], 1)]))
    book.add(make([(2, 0, ["bc"], 0)]))
    assert {r.term: (r.total, r.q, r.s1_y) for r in book.sums().collect()} == {
        "xabcx": (1, 1, 1), "abc": (2, 4, 2), "bc": (3, 5, 2)}


def test_a_half_written_version_is_written_again(spark, scratch, monkeypatch):
    book = Book(spark, scratch, KEYS, LABELS)
    book.add(units(spark, 1, [1, 2]))
    real = Book._write

    def fails(self, df, table, version):
        if table == "units":
            raise RuntimeError("lost")
        return real(self, df, table, version)
    monkeypatch.setattr(Book, "_write", fails)
    with pytest.raises(RuntimeError):
        book.add(units(spark, 2, [3, 4]))
    monkeypatch.setattr(Book, "_write", real)
    again = Book(spark, scratch, KEYS, LABELS)
    assert again.version() == 1 and os.path.exists(f"{scratch}/sums/version=2")
    assert rows(again.vocabulary()) == rows(vocabulary(units(spark, 1, [1, 2]), [], KEYS))
    assert again.add(units(spark, 3, [8])) == 2
    whole = units(spark, 1, [1, 2]).unionByName(units(spark, 3, [8]))
    assert rows(again.vocabulary()) == rows(vocabulary(whole, [], KEYS))
    with pytest.raises(ValueError):
        again.sums(3)
    assert again.vocabulary().agg(F.sum("multiplicity")).first()[0] > 0


def test_words_are_counted_once_for_their_ids(spark, scratch, monkeypatch):
    kept = []
    real = Book._write
    monkeypatch.setattr(Book, "_write", lambda self, df, table, version: kept.append((table, version)) or real(self, df, table, version))
    book = Book(spark, scratch, KEYS, LABELS)
    book.add(units(spark, 1, [1, 2]))
    assert kept.count(("word-counts", 1)) == 1
    counts = {r.term: r.freq for r in spark.read.parquet(f"{scratch}/word-counts/version=1").collect()}
    want = {}
    for r in units(spark, 1, [1, 2]).collect():
        for w in r.tokens:
            want[w.lower()] = want.get(w.lower(), 0) + 1
    assert counts == {w: n for w, n in want.items() if w != "[cls]"}
