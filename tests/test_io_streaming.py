"""O-01/O-03/O-05/O-06 sources and sinks; the streaming wrapper equals batch."""

import csv
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from clausewise.plans import analyse
from clausewise.sources import corpus, files
from clausewise.streaming import requests_stream

from conftest import SF_SMALL


def test_labelled_csv_roundtrip_with_quotes_and_newlines(spark, scratch):
    rows = [("alice", 'He said "hi", twice', "worth_reading"), ("bob", "line one\nline two", "standard_trivial"),
            ("charlie", "plain", "worth_reading"), ("dave", "not a persona", "worth_reading")]
    df = spark.createDataFrame(rows, "persona string, clause string, class string")
    root = os.path.join(scratch, "labelled")
    files.write_labelled_csv(df, root)
    back = files.read_labelled_csv(spark, root)
    got = {(r.persona, r.clause, r["class"]) for r in files.good_rows(back).collect()}
    assert got == set(rows[:3])
    bad = files.quarantined(back).collect()
    assert [(r.persona, r.clause, r.reason) for r in bad] == [("dave", "not a persona", "unknown_persona")]


def test_sinks_replace_only_what_they_write(spark, scratch):
    make = lambda persona: spark.createDataFrame([(persona, 1)], "persona string, n int")
    files.save_stage(make("alice"), scratch, "lengths")
    files.save_stage(make("bob"), scratch, "lengths")
    assert {r.persona for r in files.load_stage(spark, scratch, "lengths").collect()} == {"alice", "bob"}
    schema = "doc_id long, clause_no long, clause string, class string, mode string, title string"
    root = os.path.join(scratch, "sink")
    for mode, title in (("bow", "a b"), ("bert", "a b"), ("bow", "c")):
        files.write_classified(spark.createDataFrame([(1, 0, "x", "worth_reading", mode, title)], schema), root)
    assert {(r["mode"], r.title) for r in spark.read.parquet(root).collect()} == {("bow", "ab"), ("bert", "ab"), ("bow", "c")}
    with pytest.raises(ValueError):
        files.write_classified(spark.read.parquet(root), root)


def test_text_files_keep_line_ends_and_drop_blanks(spark, scratch):
    path = os.path.join(scratch, "policy.txt")
    with open(path, "w", newline="") as fh:
        fh.write("First clause.\r\n\r\n   \nSecond, indented\n\tThird\rFourth")
    got = [r.clause for r in files.read_text_clauses(spark, path).orderBy("clause_no").collect()]
    with open(path) as fh:  # the reference's own reading
        ref = [ln for ln in fh if ln != "" and not ln.isspace()]
    assert got == ref


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["", "\n", "\r\n", "\r", "\n\n"])
def test_a_text_file_in_many_splits_is_numbered_like_the_file(spark, scratch, small_splits, end):
    rng = random.Random(len(end))
    folder = os.path.join(scratch, "texts")
    os.makedirs(folder)
    want = {}
    for name in ("a", "b"):
        body = "".join(rng.choice(["short", "é" * 30, "  \t", "", "word " * 20, "x\ry"]) + rng.choice(["\n", "\r\n", "\r"]) for _ in range(60))
        path = os.path.join(folder, f"{name}.txt")
        with open(path, "w", newline="", encoding="utf-8") as fh:
            fh.write(body + "the last one" + end)
        with open(path, encoding="utf-8") as fh:
            want[name] = [ln for ln in fh if not ln.isspace()]
    got = {}
    df = files.read_text_clauses(spark, folder)
    assert files._file_rows(spark, folder).rdd.getNumPartitions() > 10
    for r in df.orderBy("source_file", "clause_no").collect():
        got.setdefault(r.source_file[-5], []).append((r.clause_no, r.clause))
    assert got == {n: list(enumerate(lines)) for n, lines in want.items()}


def test_a_csv_file_in_many_splits_keeps_its_records(spark, scratch, small_splits):
    rng = random.Random(5)
    want = []
    for persona in ("alice", "bob"):
        folder = os.path.join(scratch, f"persona={persona}")
        os.makedirs(folder)
        rows = [("".join(rng.choice(["word ", ", ", '"', "\n", "\r\n", "é", "\n\n"]) for _ in range(rng.randrange(1, 25))) + "x",
                 rng.choice(["worth_reading", "standard_trivial"])) for _ in range(40)]
        with open(os.path.join(folder, "data.csv"), "w", newline="", encoding="utf-8") as fh:
            writer = csv.writer(fh, lineterminator=rng.choice(["\n", "\r\n"]))
            writer.writerow(["clause", "class"])
            for k, row in enumerate(rows):
                writer.writerow(row)
                if k % 7 == 0:
                    fh.write("\n")
        want += [(persona, *r) for r in rows]
    df = files.read_labelled_csv(spark, scratch)
    got = [(r.persona, r.clause, r["class"]) for r in df.orderBy("persona", "row_in_file").collect()]
    strip = lambda rows: [(p, c.strip(" "), k) for p, c, k in rows]
    assert strip(got) == strip(want) and df.where("reason is not null").count() == 0
    assert files._file_rows(spark, scratch).rdd.getNumPartitions() > 10


def test_classified_sink_and_stage_tables(spark, scratch):
    c = analyse.classified_requests(spark, SF_SMALL)
    root = os.path.join(scratch, "classified")
    files.write_classified(c, root)
    back = spark.read.parquet(root)
    assert back.count() == c.count()
    assert back.where(F.col("title").contains(" ")).count() == 0
    st = files.save_stage(corpus.labelled_clauses(spark, SF_SMALL).select("persona", "doc_id", "clause_no"),
                          scratch, "units")
    assert files.load_stage(spark, scratch, "units", "bob").count() == st.where("persona = 'bob'").count()


def test_streaming_equals_batch(spark, scratch):
    raw = corpus.raw_requests(spark, SF_SMALL)
    in_dir, out_dir = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    requests_stream.write_request_files(raw, in_dir, files=3)
    q = requests_stream.start(spark, in_dir, out_dir, os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    stream = requests_stream.read_reports(spark, out_dir)
    batch = analyse.analyse_requests(spark, SF_SMALL)
    cols = ["doc_id", "standard_n", "worth_n", "standard_ratio"]
    assert sorted(stream.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def _answer(spark, scratch, checkpoint="ckpt", out="out"):
    q = requests_stream.start(spark, os.path.join(scratch, "in"), os.path.join(scratch, out), os.path.join(scratch, checkpoint),
                              once_within="7 days")
    q.awaitTermination(300)
    reports = requests_stream.read_reports(spark, os.path.join(scratch, out))
    rejected = spark.read.parquet(os.path.join(scratch, out, "rejected"))
    return (sorted((r.doc_id, r.standard_n, r.worth_n, r.standard_ratio) for r in reports.collect()),
            sorted((r.request_id, r.reason) for r in rejected.collect()))


def test_a_request_is_answered_once_across_batches(spark, scratch):
    """Replays in later batches and inside one, late requests, and a corrected one."""
    raw = corpus.raw_requests(spark, SF_SMALL)
    in_dir = os.path.join(scratch, "in")
    bad = raw.where("request_id % 50 = 7")
    good = raw.where("request_id % 50 <> 7")
    requests_stream.write_request_files(good.where("request_id % 3 = 0").unionByName(good.where("request_id % 9 = 0")).unionByName(bad), in_dir)
    _answer(spark, scratch)
    # replayed, late and new ones; the truncated bodies again, and one of them corrected
    fixed = raw.where("request_id = 7").selectExpr("request_id", "concat(body, '}') as body")
    requests_stream.write_request_files(good.where("request_id % 3 <> 1").unionByName(bad).unionByName(fixed), in_dir)
    _answer(spark, scratch)
    requests_stream.write_request_files(good, in_dir)
    reports, rejected = _answer(spark, scratch)

    cols = ["doc_id", "standard_n", "worth_n", "standard_ratio"]
    batch = sorted(tuple(r) for r in analyse.analyse_requests(spark, SF_SMALL).select(*cols).collect())
    assert [r for r in reports if r[0] != 7] == batch and [r[0] for r in reports].count(7) == 1
    from clausewise.sources import requests
    assert rejected == sorted((r.request_id, r.reason) for r in requests.rejected(requests.parse(raw)).collect())


def test_a_batch_replayed_after_a_failure_changes_nothing(spark, scratch):
    raw = corpus.raw_requests(spark, SF_SMALL)
    in_dir = os.path.join(scratch, "in")
    requests_stream.write_request_files(raw.where("request_id % 2 = 0"), in_dir)
    _answer(spark, scratch)
    requests_stream.write_request_files(raw, in_dir)
    want = _answer(spark, scratch)
    commits = os.path.join(scratch, "ckpt", "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    # as if the driver had died after the output of the last batch, before its commit
    shutil.copytree(os.path.join(scratch, "ckpt"), os.path.join(scratch, "ckpt2"),
                    ignore=lambda d, names: [n for n in names if d.endswith("commits") and n.strip(".").split(".")[0] == str(last)])
    assert _answer(spark, scratch, "ckpt2") == want


def test_released_stages_are_gone(spark, monkeypatch):
    from clausewise import session
    from clausewise.session import release_stages, stage
    monkeypatch.setattr(session, "_STAGES", [])  # other tests' stages stay
    one = stage(spark.range(5).toDF("x"), "one")
    path = one.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.exists(path) and one.count() == 5
    assert release_stages(spark) == 1 and not os.path.exists(path) and release_stages(spark) == 0
