"""C2 decoding ties/NaN per mode, request validation and rejects."""

import pytest

from clausewise.operators.decode import decode
from clausewise.sources import requests

NAN = float("nan")


def _decode(spark, rows, mode, strict=False):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, score array<double>")
    out = decode(df, mode, strict=strict).orderBy("i").collect()
    return [(r["class"], r["decode_error"]) for r in out]


def test_bow_mode(spark):
    got = _decode(spark, [[0.9, 0.1], [0.1, 0.9], [0.5, 0.5], [NAN, 0.2], [0.2, NAN], None, [0.3]], "bow")
    assert got == [("standard_trivial", None), ("worth_reading", None), (None, "tie"),
                   (None, "nan_score"), (None, "nan_score"), (None, "nan_score"), (None, "nan_score")]


def test_bert_mode_nan_is_not_worth(spark):
    got = _decode(spark, [[0.2], [0.8], [0.5], [NAN]], "bert")
    assert got == [("standard_trivial", None), ("worth_reading", None), (None, "tie"), (None, "nan_score")]


def test_tfm_uses_absolute_values(spark):
    got = _decode(spark, [[-3.0, 1.0], [1.0, -3.0], [-2.0, 2.0]], "tfm")
    assert got == [("standard_trivial", None), ("worth_reading", None), (None, "tie")]


def test_unknown_mode_rejected_at_plan_time(spark):
    with pytest.raises(ValueError):
        _decode(spark, [[0.1, 0.2]], "svm")


def test_strict_mode_fails_the_job(spark):
    with pytest.raises(Exception):
        _decode(spark, [[0.5, 0.5]], "bow", strict=True)


def test_request_validation(spark):
    bodies = [
        '{"alertness": "alice", "title": "t a", "text": "x\\ny"}',
        '{"alertness": "dave", "title": "t", "text": "x"}',
        '{"alertness": "bob", "title": "t", "text": ""}',
        '{"title": "t", "text": "x"}',
        '{"alertness": "charlie", "title": "t"}',
        'not json at all',
        None,
        '{"alertness": "alice", "title": "t", "text": "x"} and more',
        '{"alertness": "alice", "title": "t", "text": "x"}, {"alertness": "bob", "title": "t", "text": "y"}',
        '{"alertness": "alice", "text": "x"}',
        '{"alertness": "alice", "title": "t", "text": "x"',
        '',
        'null',
    ]
    raw = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    parsed = requests.parse(raw)
    reasons = {r.request_id: r.reason for r in parsed.collect()}
    assert reasons == {0: None, 1: "invalid_alertness", 2: "empty_text", 3: "missing_alertness",
                       4: "missing_text", 5: "invalid_json", 6: "invalid_json", 7: "invalid_json", 8: "invalid_json",
                       9: "missing_title", 10: "invalid_json", 11: "invalid_json", 12: "invalid_json"}
    ok = requests.valid(parsed).collect()
    assert [(r.request_id, r.alertness, r.text) for r in ok] == [(0, "alice", "x\ny")]
    assert requests.rejected(parsed).count() == 12
