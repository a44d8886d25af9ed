"""Clauses in chunks: the same rows as word by word, sums without cells, and plans that stay small."""

import random

import pytest
from pyspark.sql import functions as F

from clausewise.operators import descent
from clausewise.operators.descent import Model, Training, merged_columns
from clausewise.operators.encode import dictionary, encode_arrays, encode_ids
from clausewise.operators.stats import label_sums
from clausewise.operators.vocab import containment_sums, containment_vectors, counted_words, vocabulary
from clausewise.session import stage

KEYS = ["d", "c"]


@pytest.fixture(scope="module")
def units(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abü") for _ in range(r.randint(1, 6)))
    rows = [(i % 9, i // 9, [word() for _ in range(r.randint(0, 8))], r.choice([0, 1, None])) for i in range(40)]
    # a clause that comes twice, one without keys, one without tokens
    rows += [rows[3], rows[3], (None, 0, ["ab", "aab"], 1), (2 ** 60 + 1, 0, ["ab", "ab"], 1), (2 ** 60, 0, ["ab"], 0), (70, 0, [], 1), (71, 0, None, 1)]
    return stage(spark.createDataFrame(rows, "d long, c long, tokens array<string>, y int"), "chunk-units")


def counted(df):
    out = {}
    for r in df.collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_small_chunks_equal_plain_loops_and_sums_equal_sums_of_cells(spark, units):
    vocab = stage(vocabulary(units, [], KEYS), "v")
    terms, want = {r.term for r in vocab.collect()}, {}
    for r in units.collect():
        for w in r.tokens or []:
            for t in (t for t in terms if t in w):
                want[r.d, r.c, r.y, t] = want.get((r.d, r.c, r.y, t), 0) + 1
    cells = containment_vectors(units, vocab, [], KEYS, ["y"], chunk_tokens=30)
    assert {(r.d, r.c, r.y, r.term): r.n for r in cells.collect()} == want and cells.count() == len(want)
    words = containment_vectors(counted_words(units, [*KEYS, "y"]), vocab, [], KEYS, ["y"])
    assert counted(words) == counted(cells)
    sums = containment_sums(units, vocab, [], KEYS, ["y"], chunk_tokens=30)
    assert counted(sums) == counted(label_sums(cells, [], ["y"]).select(*sums.columns))


def test_values_of_a_term_come_with_its_cells(spark, units):
    vocab = stage(vocabulary(units, [], KEYS), "v")
    values = vocab.select("term", F.length("term").cast("double").alias("x"), (F.length("term") * 2).cast("double").alias("z"))
    got = containment_vectors(units, vocab, [], KEYS, values=values, chunk_tokens=30).collect()
    assert got and all(r.x == len(r.term) and r.z == 2 * len(r.term) for r in got)


def test_encoded_arrays_equal_encoded_rows(spark, units):
    known = dictionary(units.where("d < 4").select(F.explode("tokens").alias("word")))
    tokens = units.withColumn("tokens", F.concat(F.array(F.lit("[CLS]")), F.transform("tokens", lambda x: F.when(
        F.length(x) > 3, F.upper(x)).otherwise(x)), F.array(F.lit("[SEP]"), F.lit("[sep]"))))
    rows = encode_ids(tokens.select(*KEYS, F.posexplode_outer("tokens").alias("pos", "word")), known, KEYS)
    flat = lambda df: {(r.d, r.c, tuple(r.input_ids)) for r in df.collect()}
    got = encode_arrays(tokens, known, KEYS)
    assert flat(got) == flat(rows) and got.count() == rows.count()


def test_merged_columns_train_like_single_ones(spark, scratch):
    r = random.Random(3)
    units = [(i, i % 2, "test" if i % 4 == 3 else "train") for i in range(24)]
    cells = [(i, s, f"{f}") for i, _, s in units for f in {*(r.randint(0, 9) for _ in range(4)), *(r.randint(20, 80) for _ in range(5))}]
    u = stage(spark.createDataFrame(units, "unit long, y long, split string"), "u")
    c = spark.createDataFrame(cells, "unit long, split string, feature string").withColumn("n", F.lit(1).cast("long"))
    merged = stage(merged_columns(c, "unit", stage), "m")
    models, margins = [Model("one", "y"), Model("two", "y", 0.2)], []
    for name, x in (("plain", stage(c, "c")), ("merged", merged)):
        features = stage(descent.plain_features(x.where("split = 'train'"), models), "f")
        t = Training(u, x.drop("split"), features, ["unit"], models, f"{scratch}/{name}").run(3)
        margins.append({r.unit: (round(r.m_0, 9), round(r.m_1, 9)) for r in t.margins(3).collect()})
    assert margins[0] == margins[1]
    train = [f for _, s, f in cells if s == "train"]
    alone = {f for f in train if train.count(f) == 1}
    assert alone and merged.where("split = 'train'").count() < len(train)
    assert merged.where("split = 'train' and copies > 1").count() > 0


def test_plans_hold_each_step_once(frame):
    text = frame("document_features")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in text and len(text) < 20000  # selection and cells are stored tables
    for name in ("anova_f", "term_stats"):
        text = frame(name)._jdf.queryExecution().executedPlan().toString()
        assert text.count("FlatMapCoGroupsInArrow") == 1
    text = frame("pad_ids")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text.split("Subquer")[0].split("FlatMapCoGroups")[0]  # a scalar maximum, no join on the persona


def test_margins_made_in_chunks_equal_those_of_the_cells(spark):
    from clausewise.operators import linear
    from clausewise.operators import vocab as V

    rng = random.Random(7)
    rows = [("ab"[d % 2], d, c, [rng.choice(["the", "then", "lathe", "a", "at", "x"]) for _ in range(rng.randrange(5))])
            for d in range(12) for c in range(4)]
    clauses = spark.createDataFrame(rows, "persona string, doc_id long, clause_no long, tokens array<string>")
    for kind in ("long", "double"):
        known = [(p, t, w if kind == "long" else w / 7) for p in "ab" for t, w in (("the", 3), ("a", -2), ("at", 5), ("he", 1))][:-1]
        weights = spark.createDataFrame(known, f"persona string, feature string, weight {kind}")
        terms = weights.withColumnRenamed("feature", "term")
        cells = V.containment_vectors(clauses, terms.drop("weight"), ["persona"], ["doc_id", "clause_no"]).withColumnRenamed("term", "feature")
        key = lambda r: (r.persona, r.doc_id, r.clause_no)
        want = {key(r): r.margin for r in linear.margins(cells, weights, ["doc_id", "clause_no"]).collect()}
        made = V.containment_margins(clauses, terms, ["persona"], ["doc_id", "clause_no"], chunk_tokens=9)
        assert made.schema["margin"].dataType == weights.schema["weight"].dataType
        assert {key(r): r.margin for r in made.collect()} == pytest.approx(want, abs=1e-12)
    sizes = clauses.groupBy("persona", "doc_id").agg(F.count("*").alias("n_units"))
    want = {key(r): r.margin for r in linear.refit_margins(cells, sizes, weights).collect()}
    made = V.refit_containment_margins(clauses, terms, ["persona"], "doc_id", "clause_no", chunk_tokens=9).collect()
    assert len(made) == len(want) and {key(r): r.margin for r in made} == pytest.approx(want, abs=1e-12)


def test_a_chunk_fetches_its_terms_and_no_list_of_terms_per_word(spark, units):
    vocab = stage(vocabulary(units, [], KEYS), "v")
    for made in (containment_sums(units, vocab, [], KEYS, ["y"], vocab_from_same_tokens=True), containment_vectors(units, vocab, [], KEYS)):
        text = made._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in text and text.count("FlatMapGroupsInArrow") == 1


def test_terms_of_a_chunk_are_found_in_its_words(monkeypatch):
    import pyarrow as pa

    from clausewise.operators import vocab as V

    monkeypatch.setattr(V, "SLICE_BYTES", 16)
    words = ["banana", "ana", "ßaß", "日本語", "", "an" * 40, "x"]
    terms = ["an", "ana", "ß", "本", "本語", "banana", "", "zz", "n" * 9]
    word, term = V._contained(pa.array(words), pa.array(terms))
    assert list(zip(word.tolist(), term.tolist())) == [(i, j) for i, w in enumerate(words) for j, t in enumerate(terms) if t and t in w]
    none = V._contained(pa.array([], pa.string()), pa.array(terms)), V._contained(pa.array(words), pa.array([], pa.string()))
    assert all(not len(x) for pair in none for x in pair)
