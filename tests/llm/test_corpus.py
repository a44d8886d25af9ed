"""Mixing, BPE, toxicity."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from clausewise.llm import bpe, mixing, toxicity

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, encoding):
    rng = random.Random(4)
    texts = ["", None, "Hello world, don't we'll", "<|endoftext|>", "  spaces \n\n\t x", "über straße 漢字かな 🙂", "a" * 900,
             "ab" * 700, "=-" * 300, " " * 700, "".join(rng.choice("abcdetins") for _ in range(1500)),
             "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(800))]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, _text string")
    got = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    both = bpe.encode(df, PATH, P.PATTERN, decoded="decoded").collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in both) == sorted((r.doc_id, r.ids, r.decoded) for r in got)
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        assert list(r.ids) == encoding.encode_ordinary(t) and bytes(r.decoded) == t.encode() and r._text == "k"
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def sources(spark, sizes):
    rows = [(1000 * k + i, f"s{k}" if k else None, "w " * (1 + i % 5)) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string"), rows


def test_mixing_keeps_everything_and_meets_the_limits(spark):
    df, rows = sources(spark, (400, 60, 50, 20))
    tokens = {i: len(t.split()) for i, _, t in rows}
    plan = mixing.plan(df, entropy_share=None, max_repeat=2.5, block_docs=16).collect()
    n = defaultdict(int)
    read = defaultdict(int)
    for r in plan:
        n[r.source] += tokens[r.doc_id]
        read[r.source] += tokens[r.doc_id] * r.copies
        assert r.copies >= 1
    high = max(n.values())
    x = 1 - math.log(2.5) / math.log(high / min(n.values()))
    for s in n:
        want = n[s] ** x * high ** (1 - x)
        assert want - 6 <= read[s] <= want + 1
    assert {r.copies for r in plan if r.source is None} == {1}


def test_mixing_entropy_is_bisected(spark):
    df, _ = sources(spark, (300, 30, 20))
    tokens = df.select("doc_id", mixing.F.coalesce("source", mixing.F.lit("n")).alias("src"),
                       mixing.word_count(mixing.F.col("text")).alias("n_tokens"))
    totals = mixing.source_totals(tokens).cache()
    n = np.array([r.n for r in totals.collect()], float)
    x = mixing.fit_exponent(totals, 0.9, None)
    h = lambda x: -sum(w * math.log(w) for w in (n ** x / (n ** x).sum()))
    assert h(x) >= 0.9 * math.log(3) - 1e-8 > h(x + 2 ** -19)


def test_mixing_budget_blocks_and_edge_cases(spark):
    df, rows = sources(spark, (300, 40))
    small = mixing.plan(df, budget=200, block_docs=8).collect()
    assert 0 < sum(r.copies * r.n_tokens for r in small) <= 200
    again = mixing.plan(df.repartition(7), budget=200, block_docs=8).collect()
    assert sorted(map(tuple, small), key=str) == sorted(map(tuple, again), key=str)
    odd = spark.createDataFrame([(None, "a", None), (1, None, "x y"), (1, None, "x y"), (2, "b", "")],
                                "doc_id long, source string, text string").selectExpr("*", "1 as _copies", "2 as _id")
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() >= 4
    assert mixing.sample(mixing.plan(odd.limit(0))).count() == 0


def test_bpe_of_long_words_is_exact_and_bounded():
    """Runs, periods, repeated tokens and random letters, cut at every kind of border."""
    import resource
    import time

    path = PATH
    ranks = bpe.read_ranks(path)
    want = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    codec, rng = bpe.Codec(path, P.PATTERN), random.Random(7)
    some = [t.decode() for t in ranks if t.isalpha() and t.isascii()][500:900]
    texts = ["a" * n for n in (128, 129, 192, 1000, 4097)] + ["ab" * 500, "the" * 700, "abcabcab" * 300, "=" * 3000, "é" * 1500,
             " " * 900 + "x", "".join(rng.choice(some) for _ in range(900)), "".join(rng.choice("漢字かな") for _ in range(700))]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(129, 900))) for a in ("ab", "abc", "etaoin", "aeiou", "-=_") for _ in range(30)]
    for t in texts:
        assert codec.encode([t])[0].tolist() == want(t), t
    ids, ends = codec.encode(texts)
    assert ids.tolist() == [i for t in texts for i in want(t)]
    huge, start, before = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2_000_000)), time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = codec.encode([huge])[0]
    assert time.time() - start < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kB
    assert b"".join(codec.bytes[i] for i in got.tolist()) == huge.encode()
    assert got[:1000].tolist() == want(huge[:20_000])[:1000]


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(200)]
    bad = ["scumble", "scumbled", "trasher", "trashest", "idiotic"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 8)):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ".", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(None, "x"), (2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1), (5, None)], "doc_id long, toxic int")
    known = known.unionByName(spark.createDataFrame([x for x in labels if x[0] % 4 == 0], "doc_id long, toxic int"))
    model = toxicity.fit(docs, known)
    assert (np.diff(model.theta) > 0).all()
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    held = [(dict(labels)[r.doc_id], r.toxic, r.severity) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 2]
    assert np.mean([a == b for a, b, _ in held]) > 0.97
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got)
    none = toxicity.fit(docs, known.limit(0))
    assert Counter(r.severity for r in toxicity.score(docs, none).collect()) == {0.0: len(rows)}


def test_ordinal_gradient_matches_differences():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 300)
    rows, cols = np.arange(300), rng.integers(0, 3, 300)
    theta, w = toxicity.fit_ordinal(rows, cols, np.ones(300), y, 3)

    def loss(theta, w):
        s = w[cols]
        cum = np.c_[np.zeros(300), toxicity.sigmoid(theta - s[:, None]), np.ones(300)]
        return -np.log(cum[rows, y + 1] - cum[rows, y]).mean() + 0.5 * toxicity.PENALTY * (w ** 2).sum()

    best = loss(theta, w)
    for k in range(3):
        for d in (-0.05, 0.05):
            t, v = theta.copy(), w.copy()
            t[k] += d
            v[k] += d
            assert loss(t, w) > best - 1e-5 and loss(theta, v) > best - 1e-5


def test_mixing_query_equals_its_sql_on_skewed_sources(spark, scratch):
    import duckdb

    from clausewise.llm import queries_corpus

    df, _ = sources(spark, (9000, 700, 300, 40, 11))
    df.write.parquet(f"{scratch}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{scratch}/documents.parquet/*.parquet')")
    got = queries_corpus.op1_mixing(spark, scratch)
    rel = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries_corpus.OP1_SQL})")
    mine, theirs = Counter(tuple(r) for r in got.collect()), Counter(rel.fetchall())
    assert mine == theirs
    assert sum(mine.values()) > df.count()


def test_toxicity_trains_on_twenty_thousand():
    assert toxicity.SAMPLE == 20_000 and toxicity.fit.__defaults__ == (20_000,)
