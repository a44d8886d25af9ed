"""Suffix-array dedup against counting every window in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from clausewise.llm import suffix_dedup as S


def brute_windows(texts, length):
    c = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if c[t[i:i + length]] > 1] for t in texts]


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (ident, _), text, starts in zip(rows, texts, brute_windows(texts, length)):
        gone = np.zeros(len(text) + 1, bool)
        for i in starts:
            gone[i:i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((ident, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 0, b"x") for i, t in rows], "doc_id long, text string, chunk int, piece binary")
    got = S.remove(df, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                   for r in got), key=str)


def corpus(seed, n, alphabet="abcdé "):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randrange(10, 400)) for _ in range(6)] + ["a" * 500, "xyz" * 150]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < .4 else word(rng.randrange(120)) for _ in range(rng.randrange(6))))
            for i in range(n)]
    return rows + [(None, rows[3][1]), (5, rows[5][1]), (None, None), (n, ""), (n + 1, "a" * 40), (n + 2, "xy" * 230)]


@pytest.mark.parametrize("length,spans", [(200, S.SPANS), (20, (7, 4, 1)), (50, (32, 1))])
def test_equals_counting_every_window(spark, length, spans):
    rows = corpus(length, 60)
    want = brute(rows, length)
    assert sum(r[2] for r in want) > 0 and run(spark, rows, length=length, spans=spans) == want


def test_hot_anchors_small_collections_and_chunks(spark, monkeypatch):
    for name, value in (("CHUNK", 3000), ("COLLECTION", 2000)):  # read by the driver; the rest is tested in process
        monkeypatch.setattr(S, name, value)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    host = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 90)))
    rows = [(i, host() + passage + host()) for i in range(80)] + [(100, "ab" * 900)]
    assert run(spark, rows, length=40, spans=(16, 4, 1), group=3) == brute(rows, 40)


def test_nothing_repeated_and_empty(spark):
    assert run(spark, [(1, "short"), (2, None)]) == brute([(1, "short"), (2, None)], 200)
    assert run(spark, []) == []


def test_column_wise_transform_is_the_sorted_one(scratch):
    rng = random.Random(1)
    for trial in range(60):
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 7))]
        if trial % 3 == 0:
            texts.append(texts[0])
        ends = sorted((t[i:] + b"\0", j, i) for j, t in enumerate(texts) for i in range(len(t) + 1))
        bwt, lcp = S.transform(texts, 250, scratch)
        assert bwt.tolist() == [texts[j][i - 1] if i else 255 for _, j, i in ends]
        same = [0] + [next((k for k in range(len(a) - 1) if k >= len(b) - 1 or a[k] != b[k]), len(a) - 1)
                      for (a, _, _), (b, _, _) in zip(ends, ends[1:])]
        assert lcp.tolist() == same
        assert S.repeated_windows(texts, 3, scratch) == brute_windows(texts, 3)


@pytest.mark.parametrize("strip", [100_000, 150, 40])
def test_every_window_lies_in_one_piece_and_equal_windows_share_an_anchor(monkeypatch, strip):
    monkeypatch.setattr(S, "STRIP", strip)  # in this process: long texts are cut into overlapping strips
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(900))) for _ in range(20)] + [b"a" * 700, b"abab" * 100]
    cutter, anchors, seen = S.Cutter(40, 16), {}, Counter()
    for doc, base, offset, buffer in cutter.strips(texts):
        for s, a, n, anchor, _, at in zip(*cutter.pieces(base, offset, buffer)):
            assert 0 <= at < 16 and n <= at + 1
            for i in range(a, a + n):
                seen[doc[s], base[s] + i - offset[s]] += 1
                assert anchors.setdefault(buffer[i:i + 40], anchor) == anchor
    assert set(seen.values()) == {1} and sum(seen.values()) == sum(max(0, len(t) - 39) for t in texts)


def test_tasks_give_every_wanted_piece_whatever_they_remember(monkeypatch):
    import pyarrow as pa
    rng = random.Random(6)
    base = [bytes(rng.choice(b"abcdef ") for _ in range(rng.randrange(30, 600))) for _ in range(8)]
    texts = [rng.choice(base) + rng.choice(base) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * 20, pa.int32()), pa.array(texts[i:i + 20], pa.binary())], ["chunk", "text"])
               for i in range(0, 60, 20)]
    found = {}
    for strip, seen in ((100_000, 200_000), (100_000, 3)):
        monkeypatch.setattr(S, "SEEN", seen)
        cutter = S.Cutter(40, 16)
        rows = [r for b in S._piece_texts(cutter, None)(iter(batches)) for r in b.to_pylist()]
        wanted = [r for b in S._occurrences(cutter, None)(iter(batches)) for r in b.to_pylist()]
        assert {r["piece"] for r in rows} == {r["piece"] for r in wanted} and len(wanted) > len(rows)
        found[seen] = {(r["anchor"], r["piece"], r["text"], r["at"]) for r in rows}
        sliced = [b.slice(5, 9) for b in batches]
        part = [r["piece"] for b in S._occurrences(cutter, None)(iter(sliced)) for r in b.to_pylist()]
        own = [r["piece"] for i in range(0, 60, 20) for b in S._occurrences(cutter, None)(iter([pa.RecordBatch.from_arrays(
            [pa.array([0] * 9, pa.int32()), pa.array(texts[i + 5:i + 14], pa.binary())], ["chunk", "text"])])) for r in b.to_pylist()]
        assert sorted(part) == sorted(own)
    assert len(set(map(repr, found.values()))) >= 1 and found[3] == found[200_000]
