"""Quality rules and personal data: edge cases against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausewise.llm import pii, quality_rules as q

TEXTS = [None, "", " \t\n", "one", "a b c d e " * 6, "x y z w v x y z w v", "A line of words here.\nA line of words here.\n\nB",
         "é ü 漢字 \x85 x", "##% hello *** |<>|", "w " * 5000, "HALLO WELT " * 20, "mixed\ttabs\x0bvt\x0cff\rcr end"]


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c, hit = Counter(wins), set()
    for i, x in enumerate(wins):
        if c[x] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


def test_quality_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in q.apply_policy(q.ledger(q.measure(df))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert not (r.kept and r.base_failed)


def test_quality_ablation_counts_documents(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string")
    led = q.ledger(q.measure(df)).cache()
    rows = {(r.version, r.rule): r for r in q.ablations(led).collect()}
    bits = [r.failure_bits for r in led.collect()]
    for (v, rule), r in rows.items():
        m, b = q.POLICIES[v], q.BIT[rule]
        assert r.n_fails == sum(bool(x & m & b) for x in bits)
        assert r.n_rejected == sum(bool(x & m) for x in bits)
        assert r.n_only == sum((x & m) == b for x in bits)
    with pytest.raises(ValueError):
        q.apply_policy(led, "v0")


def test_quality_filter_keeps_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "Plain words make up this short text, which nobody should mind at all.", 7)],
                               "doc_id long, text string, n_words int")
    assert [tuple(r) for r in q.filter_documents(df).collect()] == [tuple(df.collect()[1])]
    assert q.filter_documents(df.limit(0)).columns == df.columns
    assert q.filter_documents(df.limit(0)).count() == 0


CARD = "4111 1111 1111 1111"
PII = [None, "", "no data", "a@b.c_d@e.f.g", "x@y", "mail to me@ex-ample.co.uk.", "1.2.3.4.5.6.7.8", "300.1.1.1 and 0255.001.2.3",
       f"card {CARD}, {CARD[:-1]}2", "+1 (234) 567-8901 or +12", "+1 234 567 8901 2345 6789 0123", "IBAN DE89 3704 0044 0532 0130 00.",
       "DE00370400440532013000", "ssn 123-45-6789 but 123-45-6789", "ü" * 50 + " q@w.er 10.0.0.1 漢 z@z.zz", "@" * 300, "1" * 400,
       "a" * 3000 + "@b.cd", " ".join(f"u{i}@h{i}.org" for i in range(300))]


def brute_pii(text):
    text = text or ""
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    for k, (pat, ok) in rules.items():
        out += [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(pat, text) if ok(m.group())]
    return ",".join(out)


def test_pii_base_spans_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE)
        assert base == brute_pii(PII[r.doc_id]), PII[r.doc_id]
        assert hashlib.sha256(base.encode()).hexdigest()
        other = {(s.kind, PII[r.doc_id][s.start:s.end]) for s in r.spans if s.kind not in pii.BASE}
        expect = {11: {("iban", "DE89 3704 0044 0532 0130 00")}, 13: {("ssn", "123-45-6789")}}.get(r.doc_id, set())
        assert other == expect


def test_pii_masking(spark):
    df = spark.createDataFrame([(1, "write me@x.org or call +1 (234) 567-8901", 3), (2, None, None), (3, f"pay {CARD}!", 1)],
                               "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.mask_documents(df).collect()}
    assert got[1].text == "write <EMAIL> or call <PHONE>" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "pay <CARD>!"


def test_pii_context_reaches_over_other_matches(spark):
    far = "ssn " + "x" * 29 + " 123-45-6789 " + "y" * 20 + " 345-67-8901"  # the label is 47 code points before the second
    texts = ["ssn 123-45-6789, 234-56-7890, 345-67-8901", "ssn 123-45-6789 but 123-45-6789", "ssn 000-45-6789 or 234-56-7890",
             far, "é ssn 123-45-6789, " + "z" * 41 + " 234-56-7890", "123-45-6789", "ssn 1 22 333 123-45-6789 234-56-7890"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pattern = re.compile(pii.PATTERNS["ssn"])
    for r in pii.detect(df).collect():
        want = [m.span() for m in pattern.finditer(r.text) if not m[0].startswith("000")
                and re.search(pii.CONTEXT["ssn"], r.text[max(0, m.start() - 40):m.start()])]
        assert [(s.start, s.end) for s in r.spans if s.kind == "ssn"] == want, r.text
        masked = r.text
        for a, b in reversed(want):
            masked = masked[:a] + "<SSN>" + masked[b:]
        assert df.where(F.col("doc_id") == r.doc_id).select(pii.mask(F.col("text"), ("ssn",)).alias("t")).first().t == masked
    short = " ".join(f"{k:02}" for k in range(10, 40))
    for kind, text in (("card", f"card {short[:30]}\n4111 1111 1111 1111"), ("ip", "server 1.2.3.4, 5.6.7.8, 9.1.2.3")):
        spans = spark.createDataFrame([(text,)], "text string").select(pii.find(F.col("text"), kind).alias("s")).first().s
        assert spans and all(x.score == (100 if re.search(pii.CONTEXT[kind], text[max(0, x.start - 40):x.start]) else 80)
                             for x in spans)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_running_sums(spark, n):
    values = [(i * 7) % 5 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    want = [sum(values[:i + 1]) for i in range(n)]
    assert df.select(F.when(F.size("v") > 0, pii.running_sums(F.col("v"))).otherwise(F.array()).alias("s")).first().s == want


LISTS = ["ssn 123-45-6789, 234-56-7890 and 345-67-8901", "123-45-6789 ssn 234-56-7890", "ssn: 900-12-3456, 666-12-3456, 123-00-4567, 123-45-0000",
         "call +49 (30) 1234-5678, +1 202 555 0143; +12", "card 4111 1111 1111 1111, 4012888888881881 and 4111111111111112",
         "iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE89370400440532013001", "ip 10.0.0.1, 256.1.1.1 and 1.2.3.4.5.6.7.8",
         "write a@b.co, c.d@e-f.org; x@y", "é" * 45 + "ssn " + "ü" * 36 + "123-45-6789", "ssn " + "x" * 37 + " 123-45-6789", None, "", "12-34-5 ssn 1-2"]


@pytest.mark.parametrize("name", ["op7_quality_rules", "op8_pii"])
def test_sql_equals_the_query_on_lists_and_edge_cases(spark, scratch, name):
    import duckdb

    from clausewise.llm import queries_rows
    rng = random.Random(8)
    texts = LISTS + TEXTS + [" ".join(rng.choice(rng.choice(LISTS[:8]).split()) + " " + rng.choice(["ssn", "tel", "x", "", "card"])
                                      for k in range(rng.randrange(12))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{scratch}/documents.parquet/*.parquet')")
    want = con.sql(queries_rows.oracle_sql()[name])
    got = queries_rows.queries()[name](spark, scratch).select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
    if name == "op8_pii":
        by_id = {r.doc_id: r for r in got}
        assert by_id[0].n_ssn == 3 and by_id[1].n_ssn == 1 and by_id[2].n_ssn == 0


def test_extra_columns_with_clashing_names_pass(spark):
    df = spark.createDataFrame([(1, "some words stand here, ten of them or a few more", 7, "m", [3])],
                               "doc_id long, text string, _m long, __m string, spans array<int>")
    got = q.apply_policy(q.ledger(q.measure(df))).first()
    assert (got._m, got["__m"], got.spans, got.n_words) == (7, "m", [3], 11)
    assert q.filter_documents(df).first() == df.first()
    assert pii.detect(df).first().spans == [] and pii.detect(df).first()._m == 7
    assert pii.mask_documents(df).first().spans == [3]
