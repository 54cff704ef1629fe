"""Rules on single values: what each says of known samples."""

import pytest
from pyspark.sql import functions as F

from billsift.functions import controls, exploration, policy, transforms, urls, values
from billsift.plans import recipe

COUNTS = '"counts":{"accepted":1,"verified":1,"documentActions":0,"pageOwnedDownloads":0,"failedScopes":0,"emptyScopes":%s}'
DOCS = [
    "https://Pay.Example.com/d/inv_12345.pdf?x-amz-date=1&b=2&a=1#top", "https://e.com/download?token=abc&id=7", "https://e.com/download?token=abc",
    "https://e.com/i/acct_1/inv_2?s=db", "https://e.com/file", "https://e.com/x/INV-99/pdf",
]
RULES = {
    "vendor": (
        urls.vendor_id,
        {
            "www.acme.com": "acme", "billing.acme.co.uk": "acme", "app.stripe-like.io": "stripe-like", "com": "com", "portal.x_y.de": "x-y",
            "acme": "acme", "": "vendor", "a.b.c.se": "c", "my.account.com": "com", "-q-.net": "q",
        },
    ),
    "date": (
        values.displayed_date,
        {
            "2024-03-05": "2024-03-05", "5.3.2024": None, "25/12/2023": "2023-12-25", "12/25/2023": "2023-12-25", "March 5, 2024": "2024-03-05",
            "5 Mar 2024": "2024-03-05", "2024-02-30": None, "1999-01-01": None, "n/a": None, "x 2024/3/5 y": "2024-03-05",
        },
    ),
    "amount": (
        values.displayed_amount,
        {
            "$1,234.50": "1234.50", "1.234,50 EUR": "1234.50", "1 234,50": "1234.50", "1,234": None, "£12.5": "12.5", "1,234,567": "1234567",
            "-7": "-7", "free": None, "€ 3.141": None,
        },
    ),
    "currency": (values.currency_of, {"$1,234.50": None, "1.234,50 EUR": "EUR", "£12.5": "GBP", "€ 3.141": "EUR"}),
    "wait": (
        lambda c: values.retry_after(c, F.lit(60).cast("long")),
        {"120": 120, " 7 ": 7, "999999": 86400, "soon": 30, "Thu, 01 Jan 1970 00:10:00 GMT": 540, "-3": 30, "": 30},
    ),
    "canonical": (urls.canonical_document_url, dict(zip(DOCS, ["https://pay.example.com/d/inv_12345?a=1&b=2", "https://e.com/download?id=7", *DOCS[2:]]))),
    "stable": (lambda c: urls.stability_score(c).cast("int"), dict(zip(DOCS, [3, 1, 1, 0, 0, 2]))),
    "next": (
        urls.next_in_link_header,
        {
            '<https://a/2>; rel="next"': "https://a/2", '<https://a/1>; rel="prev", <https://a/3>; rel="last next"': "https://a/3",
            "<https://a/4>; rel=next; title=x": "https://a/4", '<https://a/5>; rel="nextish"': None, "": None, '<https://a/6>;rel="first"': None,
        },
    ),
    "turn": (
        lambda c: recipe.same_origin(c, F.lit("https://api.example.com/v1/items?limit=5")),
        {
            "/list?page=2": "https://api.example.com/list?page=2", "https://api.example.com/list#x": "https://api.example.com/list",
            "http://api.example.com/list": None, "https://other.example.com/a": None, "https://me@api.example.com/a": None,
            "?cursor=9": "https://api.example.com/v1/items?cursor=9", "next": "https://api.example.com/v1/next",
        },
    ),
    "more": (transforms.truthy, {"true": True, "False": False, " no ": False, "0": False, "": False, "null": False, "yes": True, "OFF": False, "1": True}),
    "folder": (
        policy.folder_path,
        {
            "Accounting/2026": "Accounting/2026", " a / .. /b": "a/b", "a:b/c*": "a-b/c-", "../..": "", "1/2/3/4/5/6/7": "1/2/3/4/5/6",
            ".hidden/x": "hidden/x", "a\\b  c": "a/b c",
        },
    ),
    "type": (
        policy.content_class,
        {
            "application/pdf": "pdf", "text/html; charset=utf-8": "html", "application/ld+json": "json", " TEXT/csv ": "text", "image/png": "image",
            "application/octet-stream": "binary", "": "missing", "application/zip": "other", "application/xhtml+xml": "html",
        },
    ),
    "file": (
        policy.disposition_filename,
        {
            'attachment; filename="a.pdf"': "a.pdf", "attachment; filename*=UTF-8''%C3%A5%20b.pdf; filename=c.pdf": "å b.pdf",
            "inline; filename=x/y\\z.pdf ": "z.pdf", "attachment": None, 'attachment; filename=""': '""',
            "attachment; filename*=UTF-8''a+b.pdf": "a+b.pdf",
        },
    ),
    "secret": (
        policy.is_secret_name,
        {
            "accessToken": True, "teamId": False, "page": False, "api-key": True, "X Session": True, "organizations": False, "secretary": False,
            "csrf_x": True, "customer_id": False,
        },
    ),
    "tenant": (policy.is_tenant_name, {"accessToken": False, "teamId": True, "page": False, "organizations": True, "customer_id": True}),
    "kept": (
        lambda c: policy.is_query_value(F.split_part(c, F.lit("="), F.lit(1)), F.split_part(c, F.lit("="), F.lit(2))),
        {
            "page=2": True, "token=abc": False, "team_id=12345678": True, "q=two words": False, "range={from}": True,
            "id=0123456789abcdef01234567": False, "op=ListInvoices": True, "n=12345678901": True,
        },
    ),
    "origin": (
        policy.is_origin_pattern,
        {
            "https://a.com/*": True, "https://10.0.0.1/*": False, "http://a.com/*": False, "https://localhost/*": False, "https://*.a.com/*": False,
            "https://8.8.8.8:443/*": True, "https://a.com/x": False,
        },
    ),
    "redirect": (
        lambda c: policy.redirect_outcome(c, F.lit("https://a.com/billing")),
        {
            "https://a.com/login?n=1": "session_expired", "https://sso.b.com/x": "session_expired", "https://b.com/billing": "blocked_or_challenged",
            "https://a.com/billing/": None, "https://a.com/other": "blocked_or_challenged", "": "blocked_or_challenged",
            "https://a.com/billing?x=1": "blocked_or_challenged",
        },
    ),
    "answer": (
        lambda c: policy.sink_outcome(F.substring(c, 1, 3).cast("int"), F.length(c) == 4),
        {
            "200": "accepted", "201d": "deduped", "409d": "deduped", "409": "failed", "401": "unauthorized", "403d": "unauthorized", "500": "failed",
            "302": "failed",
        },
    ),
    "header": (
        lambda c: policy.header_marker(F.split_part(c, F.lit(": "), F.lit(1)), F.split_part(c, F.lit(": "), F.lit(2))),
        {
            "Authorization: Bearer x": "bearer", "Authorization: Basic y": "basic", "authorization: Digest z": "custom", "Cookie: a=b": "custom",
            "X-Thing: 1": "custom", "Accept: */*": None, "My-Api-Key: k": "custom", "Bad Name: x": None,
        },
    ),
    "day": (lambda c: policy.normalised("issuedAt", c), {"  a\n b ": None, "2024-02-30": None, "2024-02-29T10:00": "2024-02-29", "": None}),
    "total": (lambda c: policy.normalised("total", c), {"1 234,5": "1234.5", "12,345.6": None, "usd": None}),
    "code": (lambda c: policy.normalised("currency", c), {"usd": "USD", "us": None}),
    "note": (
        lambda c: exploration.feedback_note(c)["note"],
        {
            "  two   words ": "two words", "see https://e.com": None, "acct 12345678": None, "my password is x": None,
            "tokens are fine": "tokens are fine", "": None, "a@b": None,
        },
    ),
    "template": (
        exploration.is_safe_template_path,
        {
            "https://e.com/teams/{teamId}/billing": True, "https://e.com/download/{token}": False, "https://e.com/x/{id}": False,
            "https://e.com/teams/a{id}": False, "https://e.com/orgs/{org}/secret": False, "https://e.com/list": True,
            "https://e.com/teams/{id}/members/{m}": False,
        },
    ),
    "replay": (
        exploration.replayable_url,
        {
            "https://me:pw@e.com/a?year=2024&api_key=1#top": "https://e.com/a?year=2024&api_key=REDACTED",
            "https://e.com/a?x=Bearer%20abcdefgh12&y=2": "https://e.com/a?x=REDACTED&y=2", "https://e.com/a": "https://e.com/a",
            "https://e.com/a?mytoken=1&session-id=2": "https://e.com/a?mytoken=1&session-id=REDACTED",
        },
    ),
    "envelope": (
        lambda c: exploration.envelope(F.try_parse_json(c)),
        {
            '{"node":{"id":7}}': "node.", '{"attributes":{"id":8},"node":null}': "attributes.", '{"id":9,"node":"{x"}': "",
            '{"node":[1],"attributes":{}}': "node.", "[1]": "",
        },
    ),
    "record": (exploration.is_run_record, {
        '{"trigger":"manual","status":"ok","elapsedMs":12,' + COUNTS % "2" + "}": True, '{"trigger":"manual","status":"ok","elapsedMs":12,' + COUNTS % "1.5" + "}": False, '{"trigger":"never","status":"ok","elapsedMs":12,' + COUNTS % "2" + "}": False,
        '{"trigger":"connect","status":"partial","elapsedMs":3600001,' + COUNTS % "2" + "}": False, '{"trigger":"connect","status":"error","elapsedMs":0}': False, "no json": False, '{"trigger":"scheduled","status":"error","elapsedMs":0,' + COUNTS % '"2"' + "}": False,
    }),
}


@pytest.mark.parametrize("name", RULES)
def test_rule(spark, name):
    rule, samples = RULES[name]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", rule(F.col("s")).alias("r")).orderBy("i").collect()
    assert dict(zip(samples, [r["r"] for r in rows])) == samples
    assert rule(F.col("s")) is not None and spark.createDataFrame([(None,)], "s string").select(rule(F.col("s"))).count() == 1


CONTROLS = [
    ("Download invoice", "", "", "", "", "explicit_document_label"), ("Download", "2024-01-02", "", "Billing history", "", "invoice_context_action"),
    ("file-text", "No 7 2024-01-02", "Actions", "Billing", "", "invoice_table_action"), ("Cancel invoice download", "", "", "", "", None),
    ("Privacy policy pdf", "", "", "", "Invoices", None), ("Download", "", "", "Songs", "", None), (
        "  Hämta\n faktura ", "", "", "", "", "explicit_document_label",
    ), (None, "", "", "Invoices", "", None),
]
SECTIONS = {
    "Invoices": (True, False), "Billing": (False, True), "Sign out": (False, False), "Anna, open account menu": (False, True),
    "Receipt history": (True, True), "Settings": (False, True), "Delete account": (False, False), "Fakturering": (False, True),
    "Home": (False, False), "Past  Invoices": (True, True),
}


def test_controls(spark):
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(CONTROLS)], "i int, a string, b string, c string, d string, e string")
    found = rows.select(
        "i", controls.control_basis(*map(F.col, "abcde"), F.lit(True)).alias("basis"),
        controls.control_basis(*map(F.col, "abcde"), F.lit(None).cast("boolean")).alias("unusable"),
    ).orderBy("i").collect()
    assert [r["basis"] for r in found] == [c[5] for c in CONTROLS] and not any(r["unusable"] for r in found)


def test_sections(spark):
    rows = spark.createDataFrame([(s,) for s in SECTIONS], "s string").select(
        "s", controls.is_invoice_section(F.col("s")).alias("a"), controls.is_navigation_label(F.col("s")).alias("b"),
    ).collect()
    assert {r["s"]: (r["a"], r["b"]) for r in rows} == SECTIONS
