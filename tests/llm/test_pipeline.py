"""corpus_pipeline.run against a plain Python version of its five stages."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from clausewise.llm import bpe, mixing
from test_near import brute_join, edits
from test_rows import brute_quality


def keeps(text):
    n, chars, symbols, dup, _, failed = brute_quality(text)
    if failed or not 2 * n <= chars <= 20 * n or 10 * symbols > 3 * n:
        return False
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    letters = [c for c in text if c.isalpha()]
    return not (dup > 2 and 10 * dup > 4 * len(lines) or 2 * sum(c.isupper() for c in letters) > len(letters)
                or 2 * len(letters) < chars)


def masked(text):
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", text)
    text = re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: "<PHONE>" if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else m[0], text)
    return re.sub(r"[0-9]+(\.[0-9]+){3}", lambda m: "<IP>" if all(int(p) < 256 for p in m[0].split(".")) else m[0], text)


def md5(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def mixed(docs):
    """Copies of (doc_id, source, words); all documents of a source are in one block."""
    n = Counter()
    for _, s, w in docs:
        n[s] += w
    k, total, high, grid = len(n), sum(n.values()), max(n.values()), 1 << mixing.GRID_BITS

    def entropy(x):
        w = [(v / total) ** x for v in n.values()]
        return -sum(a / sum(w) * math.log(a / sum(w)) for a in w)

    ok = lambda g: entropy(g / grid) >= mixing.ENTROPY_SHARE * math.log(k) - 1e-9
    lo, hi = 0, grid
    if ok(grid):
        lo = grid
    else:
        while hi - lo > 1:
            lo, hi = ((lo + hi) // 2, hi) if ok((lo + hi) // 2) else (lo, (lo + hi) // 2)
    low = min(n.values())
    least = 0 if high == low else max(0, math.ceil((1 - math.log(mixing.MAX_REPEAT + 1e-9) / math.log(high / low)) * grid))
    x = max(lo, least) / grid
    out = {}
    for s in n:
        want = max(n[s], int(n[s] ** x * high ** (1 - x) + 1e-6))
        full, rest = divmod(want, n[s])
        upto = 0
        for d, w in sorted(((d, w) for d, t, w in docs if t == s), key=lambda p: (md5(mixing.SEED, full, p[0]), p[0])):
            upto += w
            out[d] = full + (upto <= rest)
    return out


def test_pipeline_equals_brute_force(spark, scratch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    rows, n = [], 0
    for source, count in (("big", 60), ("mid", 12), ("tiny", 4), (None, 6)):
        for i in range(count):
            w = [word() for _ in range(rng.randrange(15, 70))]
            if i % 5 == 1:
                w[rng.randrange(len(w))] = rng.choice(["me.you@mail.example.org", "+1 (555) 201-3344", "10.20.30.40"])
            if i % 7 == 2:
                w = ["###!"] * 30 + w[:20]
            text = " ".join(w) + "."
            rows.append((n, text, "en", source, len(text)))
            n += 1
            if i % 6 == 3:  # a near copy and an exact one
                near = [word() for _ in range(100)]
                for t in (" ".join(near), edits(rng, near, 1), " ".join(near)):
                    rows.append((n, t, "en", source, len(t)))
                    n += 1
    rows += [(n, None, None, "big", None), (n + 1, "", "", "mid", 0), (n + 2, "too short", "en", "tiny", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{scratch}/documents.parquet")
    got = Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in corpus_pipeline.run(spark, scratch).collect())

    kept = [r for r in rows if keeps(r[1] or "")]
    classes = brute_join([(r[0], r[1]) for r in kept])
    single = [(r[0], masked(r[1]), r[3]) for r in kept if classes[r[0]][0] == r[0]]
    copies = mixed([(d, s, len(t.encode().split())) for d, t, s in single])
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    want = Counter()
    for d, t, s in single:
        ids = enc.encode_ordinary(t)
        want[d, s, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(t.encode()).hexdigest()] = copies[d]
    assert got == want
    assert len(single) < len(kept) < len(rows) and max(copies.values()) > 1


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == df.columns
            assert stage(spark, docs, "").count() <= 1
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing",
                                                      "byte-level BPE"]
