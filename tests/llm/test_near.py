"""N-gram join, repeated passages and components against brute force."""

import random
from collections import defaultdict

import numpy as np

from clausewise.llm import ngram_join as nj, substring_dedup as sd
from clausewise.llm.common import blocked, components, forest, group_pairs


def shingles(text):
    w = (text or "").encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute_join(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links, parent = defaultdict(int), {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, r = find(i), find(j)
                parent[max(p, r)] = min(p, r)
    return {i: (find(i), links[i]) for i, _ in sets}


def edits(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
    return " ".join(w)


def test_join_matches_brute_force_with_blocks(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for size, length in ((40, 120), (3, 60), (1, 300), (25, 30)):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for k in range(size):
            rows.append((n, edits(rng, base, rng.randrange(3)) if k % 3 else " ".join(base)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "two words"), (n + 3, "two words"), (n + 4, "three short words"), (n + 5, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.join(df, block=8).collect()}
    assert got == brute_join(rows)
    kept = {r.doc_id for r in nj.deduplicate(df).collect()}
    assert kept == {i for i, (c, _) in brute_join(rows).items() if c == i}


BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "x30")
SCHEMA = "doc_id long, text string"


def test_join_counts_rows_with_repeated_ids_and_without_ids(spark):
    run = lambda rows: sorted((tuple(r) for r in nj.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert run([(1, BASE), (1, BASE), (2, NEAR)]) == [(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 2, 2)]
    # one id, two texts: two documents, linked to each other
    assert run([(1, BASE), (1, NEAR), (3, "a b c d e f")]) == [(1, 1, 1, 1), (1, 1, 1, 1), (3, 3, 3, 0)]
    assert run([(None, BASE), (None, BASE), (7, NEAR), (None, "a b c d e f"), (None, "a b c d e f")]) == sorted(
        [(None, 7, None, 2), (None, 7, None, 2), (7, 7, 7, 2), (None, None, None, 1), (None, None, None, 1)], key=str)


def test_deduplicate_keeps_one_row_of_a_class(spark):
    rows = [(1, BASE), (1, BASE), (2, NEAR), (None, BASE), (None, "a b c d e f"), (None, "a b c d e f"), (5, ""), (5, ""), (6, None),
            (8, "quite another text of some words"), (9, "p q r s t u v"), (9, "p q r s t u v")]
    kept = sorted((tuple(r) for r in nj.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert kept == sorted([(1, BASE), (None, "a b c d e f"), (5, ""), (5, ""), (6, None), (8, "quite another text of some words"),
                           (9, "p q r s t u v")], key=str)


def test_join_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], SCHEMA)
    assert nj.join(df.limit(0)).count() == 0 and nj.deduplicate(df.limit(0)).count() == 0
    odd = df.selectExpr("doc_id", "text", "1 as _a", "2 as rep", "'x' as root", "3 as _KEY", "4 as stands", "5 as key_a")
    assert nj.deduplicate(odd).columns == odd.columns and nj.deduplicate(odd).count() == 1


def test_minimum_matches_is_the_posterior_bound():
    need = nj.minimum_matches(0.8, 1e-3, 48, 16)
    rng = np.random.default_rng(0)
    s = rng.random(2_000_000)
    for n, least in need.items():
        m = rng.binomial(n, s)
        assert (s[m == least] >= 0.8).mean() >= 2e-4
        assert (s[m <= least - 2] >= 0.8).mean() < 2e-3


def test_group_pairs_and_forest():
    gid = np.array([1, 1, 1, 2, 3, 3])
    got = {(int(a), int(b)) for i, j in group_pairs(gid) for a, b in zip(i, j)}
    assert got == {(0, 1), (1, 2), (0, 2), (4, 5)}
    assert list(forest(6, [(np.array([0, 4]), np.array([2, 2]))])) == [0, 1, 0, 3, 0, 5]


def test_blocked_lets_every_pair_meet_once(spark):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("two", 100), ("two", 101), ("one", 7)], "k string, i long")
    rows = blocked(df, "k", "i", 8).collect()
    met = defaultdict(int)
    for key in {r.task_key for r in rows}:
        mine = [r for r in rows if r.task_key == key]
        for x in range(len(mine)):
            for y in range(x):
                if not mine[x].cross or mine[x].blk != mine[y].blk:
                    met[frozenset((mine[x].i, mine[y].i))] += 1
    assert len(met) == 50 * 49 // 2 + 1 and set(met.values()) == {1}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, r = find(a), find(b)
        parent[max(p, r)] = min(p, r)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def prose(rng, n):
    out = []
    while sum(len(s.split()) for s in out) < n:
        out.append(" ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 14))).capitalize() + ".")
    return " ".join(out)


def test_repeated_passages_are_found_and_clean_text_is_left(spark):
    rng = random.Random(9)
    shared = prose(rng, 60)
    near = prose(rng, 70).split()
    near2 = list(near)
    near2[30] = "changed"
    rows = [(0, prose(rng, 80) + "\n" + shared + "\n" + prose(rng, 40)),
            (1, prose(rng, 50)[:-1] + " and " + shared + " then " + prose(rng, 50)),
            (2, prose(rng, 90)), (3, " ".join(near)), (4, prose(rng, 20) + "\n" + " ".join(near2)), (5, None), (6, ""),
            (7, "Short line.\nOther."), (8, "Short line.\nOther.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sd.passages(sd.repeated_units(df)).cache()
    texts = dict(rows)
    hit = found.collect()
    assert {r.doc_id for r in hit} == {0, 1, 3, 4}
    assert all(r.first_doc in (0, 3) and r.across for r in hit)
    inner = [" ".join(texts[r.doc_id].split()[r.start:r.end]) for r in hit if r.doc_id == 1]
    assert sum(len(x.split()) for x in inner) >= 30 and all(x.rstrip(".") in shared for x in inner)
    clean = {r.doc_id: r.text for r in sd.remove(df).collect()}
    assert clean[0] == texts[0] and clean[2] == texts[2] and clean[3] == texts[3] and clean[5] is None
    assert len(clean[1]) < len(texts[1]) and clean[4] == texts[4].split("\n")[0] + "\n"
    assert sd.passages(sd.repeated_units(df.limit(0))).count() == 0


def test_large_groups_of_near_paragraphs_are_one_class(spark):
    rng = random.Random(3)
    base = prose(rng, 60).split()
    rows = [(i, edits(rng, base, 1)) for i in range(60)] + [(100 + i, prose(rng, 60)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (7, 512):
        hit = sd.repeated_units(df, block=block).where("kind = 0").collect()
        assert {r.doc_id for r in hit} == set(range(60)) and len({r.class_id for r in hit}) == 1


def test_bands_reach_the_recall():
    n = sd.band_count(0.8, 3, 0.999)
    assert 1 - (1 - 0.8 ** 3) ** n >= 0.999 > 1 - (1 - 0.8 ** 3) ** (n - 1)


def test_production_constants_reach_the_recall(spark):
    assert (sd.THRESHOLD, sd.ROWS, sd.RECALL, sd.MIN_SENTENCE) == (0.8, 3, 0.999, 6)
    assert 1 - (1 - sd.THRESHOLD ** sd.ROWS) ** sd.band_count() >= 0.999
    rng = random.Random(4)
    six = "one two three four five six.", "seven eight nine ten eleven twelve.", "a b c d e f."
    rows = [(k, prose(rng, 30) + " " + " ".join(six) + " " + prose(rng, 30)) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sd.repeated_units(df).where("kind = 1 and n_words = 6").collect()
    assert len(found) == 6 and {r.doc_id for r in found} == {0, 1}


def brute_windows(rows, size=51):
    """Words of each document inside a window of ``size`` words that stands at another place too."""
    places = defaultdict(list)
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - size + 1):
            places[tuple(w[p:p + size])].append((i, p))
    return {(i, x) for at in places.values() if len(at) > 1 for i, p in at for x in range(p, p + size)}


def test_long_repeats_are_found_wherever_they_stand(spark):
    rng = random.Random(12)
    verse = "\n".join(" ".join(f"v{rng.randrange(10**6)}" for _ in range(5)) for _ in range(12))
    tight, code = prose(rng, 55), [f"c{rng.randrange(10**6)}" for _ in range(70)]
    wrapped = ["\n".join(" ".join(code[i:i + n]) for i in range(0, 70, n)) for n in (7, 6)]
    rows = [(1, prose(rng, 30) + "\n" + verse + "\n" + prose(rng, 30)), (2, "Go on. " + verse),
            (3, prose(rng, 40) + " " + tight + " " + prose(rng, 40)), (4, "No. It is so and " + tight + " yes " + prose(rng, 20)),
            (5, wrapped[0]), (6, prose(rng, 25) + "\n" + wrapped[1]), (7, prose(rng, 200)),
            (8, " ".join(code[:60]) + " " + prose(rng, 30) + " " + tight.replace("\n", " "))]
    for k in range(12):  # hosts that cut one text at random places
        at = rng.randrange(60)
        rows.append((20 + k, prose(rng, rng.randrange(8, 40)) + " z " + " ".join((code + tight.split())[at:at + 51 + rng.randrange(14)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hit = sd.passages(sd.repeated_units(df)).collect()
    got = {(r.doc_id, x) for r in hit for x in range(r.start, r.end)}
    want = brute_windows(rows)
    assert {2, 4, 6, 8} <= {i for i, _ in want} and not want - got
    assert not {r.doc_id for r in hit} & {7}
    short = brute_windows(rows, 2)  # nothing but repeated words is taken
    assert not got - short
    clean = {r.doc_id: r.text for r in sd.remove(df).collect()}
    assert clean[1] == dict(rows)[1] and clean[2].split() == ["Go", "on."] and clean[5] == wrapped[0]
    left = brute_windows(list(clean.items()))
    assert not left
