"""O-11/O-12/O-13 against brute force that follows the reference's loops."""

from collections import Counter

from pyspark.sql import functions as F

from clausewise.functions.text import token_array
from clausewise.operators.vocab import containment_vectors, counted_words, existence_vectors, vocabulary

CLAUSES = [
    "the banana and an ana",
    "Banana bandana, e.g. regulation",
    "ana ana ana",
    "privacy (policy) data data",
    "x" * 80 + " xx xxx",          # a long word next to its short substrings
    "",
]


def _frame(spark, scopes=("s1", "s2")):
    rows = []
    for s in scopes:
        for i, c in enumerate(CLAUSES):
            if s == "s2" and i == 0:
                continue                  # scopes differ: s2 lacks clause 0
            rows.append((s, 7, i, c))
    df = spark.createDataFrame(rows, "scope string, doc_id long, clause_no long, clause string")
    return df.withColumn("tokens", token_array(F.col("clause")))


def _brute(spark, df):
    data = [(r.scope, r.clause_no, list(r.tokens)) for r in df.collect()]
    vocab = {}
    for scope in {d[0] for d in data}:
        cols = []
        for _, _, toks in sorted((d for d in data if d[0] == scope), key=lambda d: d[1]):
            cols.extend(dict.fromkeys(toks))
        vocab[scope] = cols
    contain, exist = Counter(), set()
    for scope, cno, toks in data:
        for term in set(vocab[scope]):
            n = sum(1 for w in toks if term in w)
            if n:
                contain[(scope, cno, term)] = n
            if term in toks:
                exist.add((scope, cno, term))
    return vocab, contain, exist


def test_vocabulary_multiplicity_and_first_position(spark):
    df = _frame(spark)
    vocab, _, _ = _brute(spark, df)
    got = vocabulary(df, ["scope"], ["doc_id", "clause_no"]).collect()
    mult = {(r.scope, r.term): r.multiplicity for r in got}
    for scope, cols in vocab.items():
        assert Counter(cols) == Counter({t: m for (s, t), m in mult.items() if s == scope})
    # first column order per scope equals the reference's concatenation order
    for scope, cols in vocab.items():
        firsts = sorted((r for r in got if r.scope == scope),
                        key=lambda r: (r.first_doc_id, r.first_clause_no, r.first_pos))
        assert [r.term for r in firsts] == list(dict.fromkeys(cols))


def test_containment_equals_triple_loop(spark):
    df = _frame(spark)
    _, contain, _ = _brute(spark, df)
    voc = vocabulary(df, ["scope"], ["doc_id", "clause_no"])
    rows = df.select("scope", "doc_id", "clause_no", F.explode("tokens").alias("word"))
    got = containment_vectors(rows, voc, ["scope"], ["doc_id", "clause_no"]).collect()
    assert {(r.scope, r.clause_no, r.term): r.n for r in got} == dict(contain)
    same = containment_vectors(rows, voc, ["scope"], ["doc_id", "clause_no"], vocab_from_same_tokens=True)
    assert {(r.scope, r.clause_no, r.term): r.n for r in same.collect()} == dict(contain)
    # 'ana' occurs twice inside 'banana' but that token counts once: banana + ana
    assert contain[("s1", 0, "ana")] == 2


def test_existence_vectors(spark):
    df = _frame(spark)
    _, _, exist = _brute(spark, df)
    voc = vocabulary(df, ["scope"], ["doc_id", "clause_no"])
    got = existence_vectors(df, voc, ["scope"], ["doc_id", "clause_no"]).collect()
    assert {(r.scope, r.clause_no, r.term) for r in got} == exist
    assert all(r.n == 1 for r in got)


def test_results_independent_of_partitioning(spark):
    """Property from SURVEY §5: the same cells whatever the input partitioning."""
    from clausewise.plans import bow

    from conftest import SF_SMALL

    units = bow.corpus_units(spark, SF_SMALL)
    a = bow.corpus_cells(units)[0].select("doc_id", "clause_no", "term", "n")
    b = bow.corpus_cells(units.repartition(7, "clause_no"))[0].select("doc_id", "clause_no", "term", "n")
    c = bow.corpus_cells(units.coalesce(1))[0].select("doc_id", "clause_no", "term", "n")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0


def test_position_packing_round_trip_and_order(spark):
    from clausewise.operators.vocab import _pack, _unpack

    vals = [(-(2 ** 63), 0, 0), (2 ** 63 - 1, 999_999_999, 999_999_999), (0, 5, 7), (-1, 3, 2), (7, 0, 1)]
    df = spark.createDataFrame(vals, "a long, b long, c long").withColumn("v", _pack(F.col("a"), F.col("b"), F.col("c")))
    out = df.select("a", "b", "c", "v", *[e.alias(n) for n, e in zip("xyz", _unpack(F.col("v")))]).collect()
    for r in out:
        assert (r.x, r.y, r.z) == (r.a, r.b, r.c)
    assert [(r.a, r.b, r.c) for r in sorted(out, key=lambda r: r.v)] == sorted(vals)


def test_containment_of_a_very_long_token(spark):
    import random

    rng = random.Random(6)
    giant = "".join(rng.choice("abcde") for _ in range(20_000))
    words = [giant, "abc", "bcd", giant[100:120], "a", "de", "zz", giant[-7:], "abcde"]
    df = spark.createDataFrame([(1, 0, [*words, "abc"]), (1, 1, ["abc", "zz"])],
                               "doc_id long, clause_no long, tokens array<string>")
    vocab = vocabulary(df, [], ["doc_id", "clause_no"])
    got = {(r.clause_no, r.term): r.n for r in containment_vectors(
        counted_words(df, ["doc_id", "clause_no"]), vocab, [], ["doc_id", "clause_no"], vocab_from_same_tokens=True).collect()}
    want = {}
    for c, toks in ((0, [*words, "abc"]), (1, ["abc", "zz"])):
        for t in set(words):
            if n := sum(t in w for w in toks):
                want[c, t] = n
    assert got == want


def test_words_are_counted_inside_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, ["x"])], "k long, tokens array<string>")
    got = {(r.k, r.word): r["k2"] for r in counted_words(df, ["k"]).toDF("k", "word", "k2").collect()}
    assert got == {(1, "a"): 1, (1, "b"): 3, (3, "x"): 1}


def test_word_map_holds_long_words_and_characters_of_several_bytes(spark, monkeypatch):
    from clausewise.operators import vocab as V

    monkeypatch.setattr(V, "SLICE_BYTES", 64)  # many slices
    words = ["straße", "aß", "ß", "日本語", "本", "a" * 300, "x😀y", "😀", "é", "none"]
    terms = ["ß", "a", "aa", "a" * 299, "本", "本語", "😀y", "é", "aß", "zz", "straße", ""]
    got = V.word_term_map(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {w: {t for t in terms if t and t in w} for w in words}
    assert {r.word: set(r.terms) for r in got.collect()} == {w: t for w, t in want.items() if t}


def test_word_map_makes_few_candidates_that_are_no_terms(spark):
    from clausewise.operators import vocab as V

    words = [f"the{i:05}tion" for i in range(4000)]
    bitmap, sizes = V._bitmap(spark.createDataFrame([(w,) for w in words], "term string"))
    made = spark.createDataFrame([(w,) for w in words], "word string").mapInArrow(V._candidates(bitmap, sizes), "word string, term string")
    # every word is a term of its own; by beginnings and lengths alone 12 x 11 / 2 substrings a word would be looked at
    assert 4000 <= made.count() < 6000
