"""Collocations against a plain-loop version; tiles against a dictionary count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from clausewise.llm import collocations as C

A_Z = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count=30, longest=4, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= min_count and len(p) > 1}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cand.items()):
                continue
            s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "x\x1cy", "nb\xa0sp", "漢字", "the", "of", "a-b", "Zeta"]
    fixed = ["the lazy dog sat", "Beta of the", "a b c d e f", "zz zz zz zz zz"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < .3 else rng.choice(words) for _ in range(rng.randrange(40))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"]) for p in parts)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows


def test_equals_plain_loops(spark):
    rows = corpus(1, 300) + [("en", None), (None, ""), ("xx", "once only"), ("en", " .,;: \t\n")]
    got = run(spark, rows, min_count=8)
    assert len(got) > 100 and got == brute(rows, 8)


@pytest.mark.parametrize("block", [8_000_000, 300, 5])
def test_blocks_add_up_however_they_are_cut(monkeypatch, block):
    import pyarrow as pa
    monkeypatch.setattr(C, "BLOCK", block)  # in this process
    rows = [(lang or "und", text) for lang, text in corpus(3, 80)] + [("en", "the lazy dog sat, " * 400), ("en", "")]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i:i + 30]], pa.string()) for c in (0, 1)], ["lang", "text"])
               for i in range(0, len(rows), 30)]
    want = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(A_Z)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for level in range(1, 5):
                for i in range(len(w) - level + 1):
                    key = level, lang, " ".join(w[i:i + level])
                    want[key] = want.get(key, 0) + 1
    every = [np.full(8, 255, np.uint8)] * 3  # tables in which every phrase may be frequent
    got, made = {}, 0
    for level in range(1, 5):
        for b in C._counter(every[:level - 1])(iter(batches)):
            made += 1
            for r in b.to_pylist():
                if r["phrase"]:
                    got[level, r["lang"], r["phrase"]] = got.get((level, r["lang"], r["phrase"]), 0) + r["n"]
    assert got == want and (made > 40) == (block < 1000)


def test_small_tables_and_top(spark):
    rows = corpus(2, 150) + [("en", "the lazy dog sat, " * 400)]
    assert run(spark, rows, min_count=5, top=7) == brute(rows, 5, top=7)
    few = spark.createDataFrame(rows, "lang string, text string")
    levels = C.phrase_counts(few, 5, 3, bits=64)  # nearly every bit is set: more rows are counted, results stay
    assert {(r.lang, r.phrase) for r in levels[2].collect()} == \
        {(r.lang, r.phrase) for r in C.phrase_counts(few, 5, 3)[2].collect()}


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(None, None)]) == []


def test_tiles_and_coordinates_agree_with_a_dictionary():
    rng = np.random.default_rng(5)
    left = np.minimum(rng.zipf(1.2, 200_000), 9000) - 1
    right = np.minimum(rng.zipf(1.2, 200_000), 9000) - 1
    where, a, b, n = C.tile_counts(left, right)
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(left.tolist(), right.tolist()))
    assert (a[where] == left).all() and (b[where] == right).all()
    assert (np.maximum(left, right) < C.TILE).sum() > C.DENSE  # a dense tile was used
    assert [len(x) for x in C.tile_counts(left[:0], right[:0])] == [0, 0, 0, 0]
