"""What may be kept of captured traffic."""

import json
import time

import pytest
from pyspark.sql import functions as F

from billsift.operators.numbering import numbered
from billsift.sources import captures, walks


def kept(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, kind string, body string")
    return [r["body"] for r in captures.sanitised_bodies(df, "body", "kind", **options).orderBy("id").collect()]


def test_forms_multipart_and_broken_bodies(spark):
    rows = [
        (
            "application/x-www-form-urlencoded; charset=utf-8", "a=1&b=2&a=3&&c&=x&d%20e=%zz&f+g=1&%C3%A9=y",
        ), ("application/x-www-form-urlencoded", "?k=v"), ("application/x-www-form-urlencoded", ""),
        (
            "multipart/form-data; boundary=x", "--x\r\nsecret\r\n--x--",
        ), ("application/json", '{"a":'), ("", '  {"a": tru}'), (None, "[1,2"), ("text/plain", "token=abc mail a@b.se"), (None, None), ("application/json", "x" * 3001), ("text/html", "<p>" + "x" * 3000), ("application/json", '{"a":NaN}'), ("application/json", "[" * 3000),
    ]
    found = kept(spark, rows, most=3000)
    assert [f and (f["outcome"], f["value"]) for f in found] == [
        (
            "form", "a=REDACTED&b=REDACTED&c=REDACTED&=REDACTED&d+e=REDACTED&f+g=REDACTED&%C3%A9=REDACTED",
        ), ("form", "k=REDACTED"), ("form", ""), ("multipart", captures.MULTIPART), ("malformed", captures.MALFORMED), ("malformed", captures.MALFORMED), ("malformed", captures.MALFORMED),
        (
            "text", "token=REDACTED mail user@example.com",
        ), None, ("truncated", captures.TRUNCATED), ("truncated", captures.TRUNCATED), ("malformed", captures.MALFORMED), ("malformed", captures.MALFORMED),
    ]


def test_pages_keep_sanitised_links_only(spark):
    page = (
        '<p>Jane</p><a href="/a?page=2&q=jane">x</a><A class=b HREF=\'https://u:p@X.se:443/users/jane/inv#t\'>y</A><a href=docs/../pdf/./1>z</a><a href="mailto:a@b.c">m</a><a href=" JavaScript:x()">n</a><a href="">e</a><a href="/q/&quot;<é">f</a>'
        + '<a href="/l">l</a>' * 600
    )
    value = kept(spark, [("text/html", page)])[0]["value"]
    links = value.split("</a>")[:-1]
    assert links[:4] == [
        '<a href="/a?page=2&amp;q=REDACTED">', '<a href="https://x.se/users/REDACTED/inv">', '<a href="/pdf/1">', '<a href="/q/&amp;quot;%3C%C3%A9">',
    ]
    assert len(links) == 500 and "Jane" not in value


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (
            "https://a.se/x/0123456789abcdef01234567/y?limit=10&token=s", "https://a.se/x/REDACTED/y?limit=10&token=REDACTED",
        ), ("https://a.se", "https://a.se/"), ("HTTP://A.se:80/?q=1&q=2&page=3#h", "http://a.se/?q=REDACTED&page=3"),
        ("/a/../../b/%2e%2E/c/..", "/"), ("//h.se/p", "/p"), ("https://a.se/contacts/a%40b.se", "https://a.se/contacts/REDACTED"), (
            "https://a.se/550e8400-e29b-41d4-a716-446655440000", "https://a.se/REDACTED",
        ), ("?page=1", "/?page=1"), ("https:// /x", "https:// /x"), ("https://a.se/a b\\c", "https://a.se/a%20b/c"),
        ("https://a.se/?page=1&page=x'y&z=1", "https://a.se/?page=REDACTED&z=REDACTED"), ("ftp://f.se/d/e", "/d/e"), (
            "https://a.se/?status=paid&include=a,b", "https://a.se/?status=paid&include=REDACTED",
        ),
    ],
)
def test_addresses(spark, url, want):
    assert spark.range(1).select(captures.sanitised_url(F.lit(url))).first()[0] == want


def test_json_bodies(spark):
    body = {
        "id": "inv_12", "account_id": 1234567, "customerName": "Jane", "fileName": "x.pdf", "created_at": "2024-01-02", "currency": "eur", "total": 1.0, "note": "hello", "iban": ["GB82 WEST 1234 5698 7654 32"], "memo": "4111 1111 1111 1111", "paid": True, "none": None,
        "url": "https://x.se/users/jane?token=1", "a@b.se": {"__redacted_key_1__": "2024-01-01"}, "list": [{"status": "open"}, "x\ud800"], "q": "mail a@b.se now",
    }
    response, request = (kept(spark, [("application/json", json.dumps(body))], request=r)[0] for r in (False, True))
    want = {
        "id": "inv_12", "account_id": 1234567, "customerName": "REDACTED", "fileName": "REDACTED", "created_at": "2024-01-02", "currency": "eur", "total": 1, "note": "REDACTED", "iban": "REDACTED", "memo": "REDACTED", "paid": True, "none": None,
        "url": "https://x.se/users/REDACTED?token=REDACTED", "__redacted_key_1__": {"__redacted_key_1__": "REDACTED"}, "list": [{"status": "REDACTED"}, "REDACTED"], "q": "mail user@example.com now",
    }
    assert json.loads(response["value"]) == want and response["gone"] == ["customerName", "iban", "memo"]
    want["id"], want["list"][0]["status"] = "REDACTED", "open"
    assert json.loads(request["value"]) == want
    asks = [
        {"operationName": "List", "query": "query List($a: ID) { x }", "variables": {"team": "{team_id}"}}, {"query": 'query { x(a: "b") }'},
        {"query": "mutation { x }"}, {"query": "query { a } # it's\n"},
    ]
    told = [json.loads(x["value"]) for x in kept(spark, [("application/json", json.dumps(a)) for a in asks], request=True)]
    assert told == [asks[0], {"query": "REDACTED"}, {"query": "REDACTED"}, {"query": "REDACTED"}]


def test_references_are_the_same_all_over_a_session(spark):
    bodies = ['{"account_id":"acc0000000000001","team_id":7654321}', '{"x":{"id":7654321},"id":"acc0000000000002","long_id":"zz"}']
    rows = [
        ("s", 1, "https://a.se/t/acc0000000000001aaaaaaaaaa1?id=acc0000000000001", bodies[0]),
        ("s", 2, "https://a.se/?id=acc0000000000002", bodies[1]), ("r", 1, "https://a.se/?id=7654321", bodies[1]), (None, 1, None, bodies[0]),
        ("s", 3, "/x", None),
    ]
    df = spark.createDataFrame(rows, "s string, n long, u string, b string").withColumn("t", F.lit("application/json"))
    found = {(r["s"], r["n"]): r for r in captures.captured(df, "s", ["n"], "u", "b", "t").collect()}
    assert len(found) == 5
    one, two, other = found["s", 1], found["s", 2], found["r", 1]
    assert json.loads(one["value"]) == {"account_id": "ref_1", "team_id": "ref_2"} and one["refs"] == ["account_id=ref_1", "team_id=ref_2"]
    assert one["url"] == "https://a.se/t/__ref_3__?id=__ref_1__"
    assert json.loads(two["value"]) == {"x": {"id": "ref_2"}, "id": "ref_4", "long_id": "REDACTED"} and two["url"] == "https://a.se/?id=__ref_4__"
    assert json.loads(other["value"]) == {"x": {"id": "ref_1"}, "id": "ref_2", "long_id": "REDACTED"} and other["url"] == "https://a.se/?id=__ref_1__"
    assert json.loads(found[None, 1]["value"]) == {"account_id": "ref_1", "team_id": "ref_2"} and found["s", 3]["value"] is None


def test_numbers_over_split_keys(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") * 7919 % 20_011).alias("v"),
    )
    got = sorted(map(tuple, numbered(df, ["k"], [F.desc("v")]).collect()))
    places: dict = {}
    want = []
    for k, v in sorted(map(tuple, df.collect()), key=lambda r: (r[0], -r[1])):
        places[k] = places.get(k, 0) + 1
        want.append((k, v, places[k]))
    assert got == sorted(want)


def test_redaction_of_long_strings_is_linear_and_names_do_not_clash():
    start = time.time()
    out = walks._without_people(json.dumps({"v": "a" * 400_000 + "!", "a@b.se": 1, "__redacted_key_1__": 2}))
    assert time.time() - start < 5
    assert list(json.loads(out)) == ["v", "__redacted_key_2__", "__redacted_key_1__"]
