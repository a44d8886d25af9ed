"""Scale guards on the physical plans of every registered query: no
cartesian product or nested-loop join, and parquet scans read only the
columns a query needs."""

import re

import pytest

from clausewise.plans.registry import queries

from conftest import SF_SMALL

@pytest.mark.parametrize("name", sorted(queries()))
def test_plan_has_no_pairwise_join_and_prunes_columns(frame, name):
    df = frame(name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        # documents carry 5 columns, none of our queries needs lang or n_chars
        assert "n_chars" not in schema and "lang:" not in schema, schema


def _executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["analyse_requests", "annotated_documents", "worth_indices"])
def test_reports_need_no_exchange(spark, name):
    plan = _executed(queries()[name](spark, SF_SMALL))
    assert "Exchange" not in plan, plan


def test_rejects_have_every_reason(spark):
    got = {r.reason for r in queries()["rejected_requests"](spark, SF_SMALL).collect()}
    assert got == {"invalid_json", "missing_alertness", "invalid_alertness", "missing_text", "empty_text", "missing_title"}


@pytest.mark.parametrize(("name", "most"), [("model_input", 2), ("train_test_split", 3)])
def test_documents_are_scanned_no_more_than_needed(spark, name, most):
    """model_input: clauses and dictionary; the split: histogram, boundary cell, tagging."""
    plan = _executed(queries()[name](spark, SF_SMALL))
    assert plan.count("documents.parquet") <= most, plan
