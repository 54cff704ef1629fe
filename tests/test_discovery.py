"""Edges of the discovery rules: nulls, empty tables, what is no JSON, and the bounds of walks."""

import json

from pyspark.sql import functions as F

from billsift.functions import controls, exploration
from billsift.operators import actions
from billsift.sources import walks


def test_nulls_have_no_basis_claim_or_identity(spark):
    text = F.lit(None).cast("string")
    texts = F.lit(None).cast("array<string>")
    claim = controls.row_claim(texts, texts, text)
    row = spark.range(1).select(
        controls.control_basis(
            text, text, text, text, text, F.lit(True),
        ).alias("basis"), claim.alias("claim"), controls.action_identity(text, claim).alias("id"),
        controls.is_navigation_label(text).alias("label"), exploration.is_run_record(text).alias("record"), exploration.is_safe_template_path(text).alias("path"),
    ).first()
    assert tuple(row) == (None, None, None, False, False, False)


def test_enumeration_of_equal_actions(spark):
    rows = [(1, None, "a"), (1, None, "a"), (1, None, "b"), (1, None, None), (1, "https://e.com", "b"), (2, None, None)]
    df = spark.createDataFrame(rows, "page int, url string, action string")
    found = {r["page"]: r for r in actions.enumeration(df, ["page"]).collect()}
    assert found[1].asDict() == {
        "page": 1, "observed": 5, "direct": 1, "actions": 1, "resolved": 2, "unresolved": 3, "unstable": 1, "ambiguous": 2, "truncated": False,
    }
    assert (found[2]["observed"], found[2]["unstable"], found[2]["resolved"]) == (1, 1, 0)
    assert actions.enumeration(df.limit(0), ["page"]).count() == 0


def test_walk_keeps_its_bounds(spark):
    deep = "x"
    for _ in range(12):
        deep = {"pdf_url": deep}
    bodies = [(1, json.dumps({"pdf_url": ["u"] * 300})), (2, json.dumps(deep)), (3, None), (4, "{"), (5, json.dumps({"a": {"download_url": "v"}}))]
    rows = walks.document_fields(spark.createDataFrame(bodies, "id int, body string"), "body").collect()
    assert {i: sum(r["id"] == i for r in rows) for i in range(1, 6)} == {1: walks.CHILDREN, 2: 0, 3: 0, 4: 0, 5: 1}


def test_redaction_of_payments_and_keys(spark):
    body = {"pay": "4111 1111 1111 1111", "ref": "4111 1111 1111 1112", "to": "DE89370400440532013000", "a@b.se": 1, "cardNumber": "x", "n": 5}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, None), (3, "no")], "id int, body string")
    kept = {r["id"]: r["body"] for r in walks.fixture(df, "body").collect()}
    assert json.loads(kept[1]) == {"pay": "REDACTED", "ref": "4111 1111 1111 1112", "to": "REDACTED", "__redacted_key_1__": 1, "cardNumber": "REDACTED", "n": 5}
    assert kept[2] is None and kept[3] is None
    found = {r["id"]: r["body"] for r in walks.evidence(df, "body").collect()}
    assert found[1]["paths"] == ["pay", "to", "cardNumber"] and found[2] is None and found[3] is None
