"""Guards, previews, scopes found page by page."""

import pytest
from pyspark.sql import functions as F

from billsift.functions import guards, labels
from billsift.operators import admission

E = "https://e.se"


@pytest.mark.parametrize(
    ("url", "ok"),
    [
        ("/billing?page=2", True), (E + "/invoices/offset/20/", True), (E + "/billing?cursor=" + "x" * 512, True), (E + "/billing?cursor=" + "x" * 513, False), (
            E + "/billing?access_token=1&page=2", False,
        ), (E + "/billing/cancel?page=2", False), ("http://e.se/billing?page=2", False), ("https://u@e.se/billing?page=2", False),
        ("https://f.se/billing?page=2", False), (E + "/billing", False), (E + "/billing?page=2#a", False), (
            E + "/billing/" + "x" * 320 + "?page=2", False,
        ), (E + "/home?page=2", False), ("billing?page=2", False), (None, False), ("/billing?page=" + "1" * 1200, False),
    ],
)
def test_continuations(spark, url, ok):
    got = spark.range(1).select(guards.continuation_url(F.lit(url).cast("string"), F.lit(E))).first()[0]
    assert (got is not None) is ok and (got is None or got.startswith(E))


def test_scopes_fail_closed(spark):
    ok = lambda values, more=False, nxt=None, status=200: (status, values, more, nxt)
    cases = {
        "one": ([ok(["a", ""])], ["a"], None), "two": ([ok(["a"], True, "c"), ok(["b"])], ["a", "b"], None), "auth": (
            [ok(["a"], True, "c"), ok([], status=401)], None, "auth_expired",
        ), "down": ([ok(["a"], status=503)], None, "http_error"),
        "many": (
            [ok([str(i) for i in range(51)])], None, "too_many_values",
        ), "blank": ([ok([""])], None, "no_value"), "lost": ([ok(["a"], True)], None, "continuation_failed"), "long": ([ok(["a"], True, "c" * 2049)], None, "invalid_cursor"),
        "again": (
            [ok(["a"], True, "c"), ok(["b"], True, "c")], None, "repeated_cursor",
        ), "cap": ([ok([str(i)], True, f"c{i}") for i in range(9)], None, "page_cap"), "gone": ([ok(["a"], True, "c")], None, "missing_page"),
    }
    rows = [(name, i, *p) for name, (pages, _, _) in cases.items() for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "k string, page int, status int, found array<string>, more boolean, following string").repartition(3)
    got = {r["k"]: (r["values"], r["cause"]) for r in admission.config_values(df, ["k"], "page", "status", "found", "more", "following", 5).collect()}
    assert got == {name: (values, cause) for name, (_, values, cause) in cases.items()}
    loose = {
        r["k"]: (r["values"], r["cause"]) for r in admission.config_values(
            df.where("k IN ('lost', 'one', 'gone')"), ["k"], "page", "status", "found", None, "following", 5,
        ).collect()
    }
    assert loose == {"lost": (["a"], None), "one": (["a"], None), "gone": (None, "missing_page")}


def test_previews(spark):
    ref = lambda id, url="https://a.se/x", action=False: (id, url, action)
    cases = {
        "good": (
            [ref("1"), ref("1", "https://b.se/x"), ref("2", None, True)], (2, None),
        ), "none": ([], (None, "no_documents")), "blank": ([ref("1"), ref("")], (None, "invalid_identity")), "null": ([ref(None), ref("1", "https://b.se/x")], (None, "invalid_identity")), "path": ([ref("1", None)], (None, "invalid_document_path")),
        "odd": ([ref("1", "x")], (None, "invalid_document_path")), "other": (
            [ref("1", "https://b.se/x"), ref("undefined")], (None, "unapproved_document_origin"),
        ), "user": ([ref("1", "https://u@a.se/x")], (None, "unapproved_document_origin")), "many": ([ref("1")] * 501, (None, "too_many_documents")), "far": ([ref("1")], (None, "no_documents")),
    }
    rows = [(name, 20 if name == "far" else 0, i, *r) for name, (refs, _) in cases.items() for i, r in enumerate(refs)]
    refs = spark.createDataFrame(rows, "k string, scope int, pos int, id string, document_url string, action boolean")
    candidates = spark.createDataFrame([(name, ["https://a.se"], False) for name in cases], "k string, origins array<string>, requests boolean")
    assert {r["k"]: (r["count"], r["code"]) for r in admission.previews(candidates, refs, "k").collect()} == {name: want for name, (_, want) in cases.items()}


def test_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [
        one(labels.ordinal_day(F.lit(d))) for d in (1, 2, 3, 4, 11, 12, 13, 21, 22, 31)
    ] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "22nd", "31st"]
    assert [one(labels.title_case(F.lit(s))) for s in ("acme", "stripe-like", "a-1b-c", "")] == ["Acme", "Stripe Like", "A-1b C", ""]
    assert [
        one(labels.invoice_label(F.lit(n).cast("string"), F.lit(f).cast("string"))) for n, f in (
            ("7", "x"), ("", "a b.PDF"), (None, "document-0123456789ab.pdf"), (None, "x-unknown.pdf"), (None, None),
        )
    ] == ["7", "a b", "Invoice", "Invoice", "Invoice"]
