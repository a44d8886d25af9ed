"""WARC, exact top-k, main text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.llm import html_blocks as hb, topk, warc


def test_warc_round_trip_types_and_determinism(spark, scratch):
    big = "<p>" + "ä" * 800 + "</p>"
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c", "small"), (4, "http://d", "small"),
            (5, "http://e\r\nx", None), (6, "http://f", ""), (9, None, big), (None, "http://n", big), (7, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    files = []
    for n in (3, 5):
        folder = f"file://{scratch}/{n}"
        files.append(sorted((r.file, r.sha256, r.records) for r in warc.write(df.repartition(n), folder).collect()))
        got = sorted(warc.read(spark, folder).collect(), key=str)
        assert len(got) == len(rows)
        for r in got:
            if r.record_type == "response":
                assert r.refers_to is None and bytes(r.payload) in {(h or "").encode() for _, _, h in rows}
            else:
                assert r.refers_to == 9 and r.page_id in (1, 2) and bytes(r.payload) == b"" and r.payload_bytes == len(big.encode())
        assert sum(r.record_type == "revisit" for r in got) == 2
    assert files[0] == files[1]
    assert warc.write(df.limit(0), f"file://{scratch}/none").count() == 0


def test_warc_rolls_by_compressed_size_and_detects_damage(spark, scratch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "u", "".join(rng.choice("abcdefgh0123") for _ in range(3000))) for i in range(20)],
                               "page_id long, url string, html string")
    folder = f"file://{scratch}/rolled"
    files = warc.write(df, folder, shard_bytes=20_000, file_bytes=4000).collect()
    assert len({f.shard for f in files}) > 1 and len(files) > 3 and sum(r.records for r in files) == 20
    assert all(r.page_id is not None for r in warc.read(spark, folder).collect())
    with open(f"{scratch}/rolled/{files[0].file}", "r+b") as f:
        f.seek(50)
        f.write(b"xx")
    with pytest.raises(Exception, match="not the file"):
        warc.read(spark, folder).collect()


@pytest.mark.parametrize("kind", ["outlier", "null", "one range", "extremes"])
def test_warc_shards_are_bounded_for_any_keys(spark, scratch, kind):
    rng = random.Random(3)
    keys = {"outlier": [*range(300), 2 ** 62], "null": [None] * 300 + [7], "one range": [5_000_000 + i for i in range(300)] + [0, 10 ** 12],
            "extremes": [-2 ** 63, 2 ** 63 - 1, *range(300)]}[kind]
    rows = [(k, "u", "".join(rng.choice("abcdef") for _ in range(500))) for k in keys]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    written = [warc.write(df.repartition(n), f"file://{scratch}/{n}", shard_bytes=10_000, file_bytes=10 ** 9).collect() for n in (2, 5)]
    per = {}
    for f in written[0]:
        per[f.shard] = per.get(f.shard, 0) + f.records
    assert sum(per.values()) == len(rows) and max(per.values()) <= 80 and len(per) >= 8
    assert sorted((f.file, f.sha256) for f in written[0]) == sorted((f.file, f.sha256) for f in written[1])
    got = warc.read(spark, f"file://{scratch}/2").collect()
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in got), key=str) == sorted(((k, h) for k, _, h in rows), key=str)


def brute_topk(rows, k, kind=np.float32):
    ints = [(i, [a * 1024 // b for a, b in (float(kind(x)).as_integer_ratio() for x in v)]) for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(ints):
        if q is not None and q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, v)), i is None, i or 0) for n, (i, v) in enumerate(ints)
                       if n != at and len(v) == len(x))
            out += [(q, n + 1, None if no else i, -d if -2 ** 63 <= -d < 2 ** 63 else None) for n, (d, no, i) in enumerate(s[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [3, 10])
def test_topk_matches_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(0, 420)]
    rows += [(1000 + i, rows[5][1]) for i in range(15)] + [(700, [1.0] * 8), (701, [1.0] * 8), (702, [1e6, 2.0])]
    rows += [(800, None), (801, [None] * 8), (900, [float("nan")] * 8), (901, [float("inf")] * 8), (1100, []), (None, [1.0] * 8)]
    rows += [(300, rows[300][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, k).collect()), key=str)
    assert got == brute_topk(rows, k)
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_is_exact_for_every_finite_vector_and_row(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 10)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 64)]) for i in range(40)]
    rows += [(100, [1.5e6] * 64), (200, [3e6] * 64), (201, [-3e6] * 64), (300, [1e300] * 64), (301, [-1e300] * 64), (302, [1.7e308] * 64)]
    rows += [(100, [1.5e6] * 64), (0, rows[7][1]), (None, rows[3][1]), (None, [2.9e6] * 64), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, b"") for i, v in rows], "vec_id long, embedding array<double>, rid int, wide binary")
    got = sorted((tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, 12).collect()), key=str)
    assert got == brute_topk(rows, 12, float)
    assert (200, 1, 302, None) in got and any(s is not None and s > 2 ** 40 for *_, s in got)


ARTICLE = ("<article><h1>Title &amp; more</h1><p>The first   paragraph is long enough to be one, it says.<p><b>Second has a bold "
           "start. And goes on<br>after a break.</article>")
SHELL = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"


def test_blocks_and_labeller(spark):
    texts = [t for _, t, _ in hb.blocks(SHELL + ARTICLE)]
    assert texts == ["T", "Home", "Title & more", "The first paragraph is long enough to be one, it says.",
                     "Second has a bold start. And goes on after a break."]
    rng = random.Random(2)
    words = "the of and to in that is was for on with as his they at be this from have or by one had not but".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows, want = [], {}
    for i in range(60):
        body = [prose(rng.randrange(2, 60)) for _ in range(rng.randrange(1, 7))]
        want[i] = "\n".join(["Head " + str(i), *body])
        rows.append((i, f"u{i}", SHELL + f"<div class='ad'>{prose(6)}</div><article><h1>Head {i}</h1>"
                     + "".join(f"<p>{b}</p>" for b in body) + f"</article><footer>&copy; {prose(5)}</footer></body></html>"))
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<<<>>><p"), (None, "u", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_html", F.lit(1))
    got = {r.page_id: r for r in hb.extract(df).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert np.mean([got[i].text == want[i] for i in want]) > 0.9
    assert got[100].text == "" and got[101].text == ""


def test_lstm_gradient_matches_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in hb.init(rng).items()}
    x = rng.normal(0, 1, (2, 3, hb.WIDTH))
    live = np.array([[True, True, True], [True, True, False]])
    weight = rng.normal(0, 1, (2, 3, hb.HIDDEN)) * live[:, :, None]
    for d in "fb":
        _, memo = hb._forward(p, d, x, live, True)
        grad = hb._backward(p, d, x, memo, weight)[f"w{d}"]
        for i, j in ((0, 0), (5, 30), (hb.WIDTH + 3, 50), (hb.WIDTH + 7, 90)):
            old, diff = p[f"w{d}"][i, j], []
            for e in (1e-4, -1e-4):
                p[f"w{d}"][i, j] = old + e
                diff.append((hb._forward(p, d, x, live, False)[0] * weight).sum())
            p[f"w{d}"][i, j] = old
            assert abs((diff[0] - diff[1]) / 2e-4 - grad[i, j]) < 1e-2


def test_deep_pages_with_long_class_lists_keep_their_marks():
    util = " ".join(f"u{k}" for k in range(20))
    deep = "".join(f"<div class='{util} d{k}'>" for k in range(12))
    page = (f"<html><body class='has-sidebar'><nav>Home</nav><div class='{util} article-body'>{deep}<table><tr><td><p>True text.</p></td></tr>"
            f"</table>{'</div>' * 12}<section class='{util} comments'><ol><li>{deep}<p>A reader says.</p>{'</div>' * 12}</li></ol>"
            "</section></div></body></html>")
    found = hb.blocks(page)
    assert [t for _, t, _ in found] == ["Home", "True text.", "A reader says."]
    assert all(len(p) >= 15 for p, _, _ in found[1:])
    assert list(hb.weak_labels(found)) == [0, 1, 0]
    features = hb.Features()
    with_article = ("html", "body", "article") + ("div",) * 10 + ("p",)
    without = ("html", "body", "section") + ("div",) * 10 + ("p",)
    assert np.abs(features._path(with_article) - features._path(without)).max() > 0.1
    late = ("html", f"div {' '.join('div.' + x for x in util.split())} div.comments")
    assert np.abs(features._path(late) - features._path((late[0], late[1].replace("div.comments", "div.u99")))).max() > 0.1


def plain_lstm(p, x):
    """One page, one direction after the other, number by number."""
    def sig(v):
        return 1 / (1 + np.exp(-v))
    out = np.zeros(len(x)) + p["o"][0]
    for k, d in enumerate("fb"):
        h, c = [0.0] * hb.HIDDEN, [0.0] * hb.HIDDEN
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = [p[f"c{d}"][j] + sum(x[t][i] * p[f"w{d}"][i, j] for i in range(hb.WIDTH))
                 + sum(h[i] * p[f"w{d}"][hb.WIDTH + i, j] for i in range(hb.HIDDEN)) for j in range(4 * hb.HIDDEN)]
            n = hb.HIDDEN
            c = [sig(z[n + j]) * c[j] + sig(z[j]) * np.tanh(z[3 * n + j]) for j in range(n)]
            h = [sig(z[2 * n + j]) * np.tanh(c[j]) for j in range(n)]
            out[t] += sum(h[j] * p["v"][k * n + j] for j in range(n))
    return sig(out)


@pytest.mark.parametrize("at_once", [1024, 2])
def test_lstm_equals_plain_loops(monkeypatch, at_once):
    monkeypatch.setattr(hb, "STEPS_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    p = hb.init(rng)
    pages = [rng.normal(0, 1, (n, hb.WIDTH)).astype(np.float32) for n in (5, 1, 3)]
    x, live = hb._pad(pages, hb.WIDTH)
    got = hb.probabilities(p, x, live)
    for row, page in zip(got, pages):
        assert np.abs(row[:len(page)] - plain_lstm(p, page)).max() < 1e-4


def test_slashes_references_and_blocks():
    cut = lambda page: [(t, " ".join(e.split()[0] for e in path)) for path, t, _ in hb.blocks(page)]
    assert cut("<div class=outer><article><p>one</p><div/>two</div><p>three</p></article></div>") == [
        ("one", "div article p"), ("two", "div article div"), ("three", "div article p")]
    assert cut("a<br/>b<hr/>c<img src=x/>d") == [("a b", ""), ("cd", "")]
    assert [n for _, _, n in hb.blocks("<p>x <a href=http://x.com/>link</a> y</p>")] == [4]
    assert cut("<p>R&am<b>p;</b>D &amp; &lt;p&gt; &#x41;&eacute;</p>") == [("R&amp;D & <p> Aé", "p")]
    assert cut("<p>a<li>b<td>c</p>d") == [("a", "p"), ("b", "p li"), ("c", "p li td"), ("d", "")]


def test_a_page_of_very_many_blocks(spark):
    page = "<article>" + "<p>A sentence that stands here.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert hb.extract(df).first().n_chars == 20_000 * 29 - 1


def test_ties_at_one_half_are_left_out():
    p = {k: np.zeros_like(v) for k, v in hb.init(np.random.default_rng(0)).items()}
    assert hb.main_texts(p, hb.Features(), ["<p>x</p>", ""]) == ["", ""]
