"""How pages follow, where ids come from, which tenant a page is of, and which requests are read-only."""

import json

import pytest
from pyspark.sql import functions as F

from billsift.functions import policy
from billsift.operators import tracing
from billsift.sources import graphql, walks


@pytest.mark.parametrize(
    ("url", "body", "want"),
    [
        (
            "https://e.se/a?cursor=x", {"data": {"has_more": False}, "page": {"meta": {"next_cursor": "c"}, "hasMore": 1}},
            ("cursor", "page.meta.next_cursor", "page.hasMore", None, None),
        ),
        (
            "https://e.se/a?after=x", {"has_more": True, "a": {"b": {"endCursor": "c"}, "hasNextPage": "y"}, "c": {"has_more": 1}},
            ("cursor", "a.b.endCursor", "a.hasNextPage", None, None),
        ),
        (
            "https://e.se/a?page=1", {"next_page": "2", "has_more": True}, ("cursor", "next_page", "has_more", None, None),
        ), ("https://e.se/a?page=1", {"next_page": 2, "has_more": True}, ("page", None, "has_more", None, None)),
        ("https://e.se/a?cursor=x", {"cursor": ""}, None), ("https://e.se/a", {"cursor": "c"}, None), (
            "https://e.se/a", {"links": {"next": "/p"}, "cursor": "c"}, ("next-url", "links.next", None, None, None),
        ), ("https://e.se/a", {"next": "/p"}, None),
        ("https://e.se/a", {"x": {"Link": {"NEXT": "https://e.se/2"}}}, ("next-url", "x.Link.NEXT", None, None, None)), ("https://e.se/a", {"nextUrl": "p"}, None), (
            "https://e.se/a?Offset=0&limit=1000&per_page=20", {"has_more": None, "b": {"hasMore": "no"}}, ("offset", None, "b.hasMore", 20, 20),
        ),
        ("https://e.se/a?offset=0", {"has_more": True}, ("offset", None, "has_more", 50, 50)), ("https://e.se/a?offset=0", {"list": [{"has_more": True}]}, None), (
            "https://e.se/a?P=2&limit=30&per_page=0", {"has_more": True}, ("page", None, "has_more", None, 30),
        ), ("https://e.se/a?page=1", {}, None),
    ],
)
def test_pagination(spark, url, body, want):
    rows = spark.createDataFrame([(1, url, json.dumps(body))], "k int, url string, body string")
    found = [tuple(r)[1:] for r in tracing.pagination(rows, ["k"], "url", "body").collect()]
    assert found == ([want] if want else [])


A, B, C = "00000000-0000-4000-8000-000000000002", "team_0000000000000001", "1234567890"


def traced(spark, entries):
    rows = [("s", i, *e) for i, e in enumerate(entries)]
    df = spark.createDataFrame(rows, "session string, pos long, url string, request_body string, content_type string, response_body string")
    lists = spark.createDataFrame([("s", len(rows) - 1)], "session string, pos long")
    return {(r["token"], r["location"]): (r["config_id"], r["source"], r["path"]) for r in tracing.provenance(df, lists).collect()}


def test_provenance(spark):
    js = "application/json"
    accounts = json.dumps({"accounts": {A: {"account": {"account_id": A}}, "default": {"account": {"account_id": A}}}, "account_ordering": [A]})
    entries = [
        ("https://e.se/check", None, js, accounts), ("https://e.se/page", None, "text/html", json.dumps({"account_id": A})), (f"https://e.se/get?id={B}", None, js, json.dumps({"teamId": B})), (
            "https://e.se/post", json.dumps({"id": B}), js, json.dumps({"teamId": B}),
        ),
        (
            "https://e.se/list", None, js, json.dumps({"teams": [{"ref": B}], "other": {"n": 1234567890}}),
        ), ("https://e.se/bad", None, js, "{"), ("https://e.se/none", None, js, None),
        (f"https://e.se/api/{C}/invoices?limit=4&account_id={A}", json.dumps({"variables": {"workspace id": B, "n": ["ref_7"]}}), js, json.dumps({"x": A})),
    ]
    # a number is not the text of an id, and the reference has no source
    assert traced(spark, entries) == {(A, "url"): ("account_id", 0, "accounts.default.account.account_id"), (B, "body"): ("workspace_id", 4, "teams.0.ref")}
    entries[-1] = (f"https://e.se/api/{A}/invoices", json.dumps({"v": ["ref_7"]}), js, None)
    entries[5] = ("https://e.se/me", None, js, json.dumps({"id": "ref_7", "user": {"account": {"key": A}}}))
    assert traced(spark, entries) == {(A, "url"): ("account_id", 0, "accounts.default.account.account_id"), ("ref_7", "body"): ("v", 5, "id")}
    assert traced(spark, entries[-1:]) == {}


def bound(spark, page, *resources, hosts=()):
    pages = spark.createDataFrame([(1, page, list(hosts))], "page int, url string, hosts array<string>")
    rows = [(1, i, url, method, sent, safe, body) for i, (url, body, method, sent, safe) in enumerate(resources)]
    df = spark.createDataFrame(rows, "page int, pos int, url string, method string, request_body string, safe_post boolean, body string")
    return [tuple(r)[1:] for r in tracing.tenant_bindings(pages, df).collect()]


def test_tenant_bindings(spark):
    t, page = "12345678", "https://e.se/w/12345678/home"
    get = lambda url, body: (url, json.dumps(body), "GET", None, None)
    deep = {"a": {"workspace": {"id": t}}, "list": [{"team_id": t}], "z": {"orgId": int(t), "account": {"id": t}}}
    assert bound(spark, page, get("https://e.se/x", deep)) == [("https://e.se/w/{orgId}/home", "orgId", "z.orgId", 0)]
    assert bound(
        spark, page, get("https://e.se/x", {"workspace": {"id": t}, "team": {"id": t}}),
    ) == [("https://e.se/w/{workspace}/home", "workspace", "workspace.id", 0)]
    assert bound(
        spark, page, get(f"https://e.se/x?y={t}", {"team_id": t}), get("https://f.se/x", {"team_id": t}),
        get("https://e.se/REDACTED", {"team_id": t}), ("https://e.se/p", json.dumps({"team_id": t}), "POST", "{}", False),
        get("https://e.se/y", {"id": t, "teamid": "1"}),
    ) == []
    assert bound(
        spark, page, ("https://e.se/p", json.dumps({"team_id": t}), "POST", f'{{"a":"{t}"}}', True),
        ("https://api.e.se/p", json.dumps({"team_id": t}), "POST", "{}", True), get("https://e.se/x", {"org": t}), hosts=["api.e.se"],
    ) == [("https://e.se/w/{team_id}/home", "team_id", "team_id", 1)]
    assert bound(spark, "https://e.se/team/12345678/billing") == [("https://e.se/team/12345678/billing", None, None, None)]
    assert bound(spark, page + "?x=1", get("https://e.se/x", deep)) == [] == bound(spark, "https://e.se/12345678/a/87654321", get("https://e.se/x", deep))
    wide = {f"k{i}": {"a": i} for i in range(300)} | {"team_id": t}
    assert bound(spark, page, get("https://e.se/x", wide)) == []  # beyond the 200 members that are looked at


def test_scalars_have_their_turns(spark):
    body = {"a": {"b": 1, "c": [True, {"d": None}]}, "e": "x"}
    found = walks.scalars(spark.createDataFrame([(json.dumps(body),), ("{",), (None,)], "body string"), "body").collect()
    assert [(r["place"], r["turn"], r["path"], r["key"], r["parent"], r["listed"], r["kind"], r["value"]) for r in found] == [
        (0, 2, "a.b", "b", "a", False, "number", "1"), (
            1, None, "a.c.0", "c", "a", True, "boolean", "true",
        ), (2, None, "a.c.1.d", "d", "c", True, "null", None), (3, 1, "e", "e", None, False, "string", "x")
    ]


HEADERS = [("Content-Type", "application/JSON")]
QUERY = "query Bills($team: ID!, $after: String) { # page\n bills(team: $team, first: 20, after: $after, state: PAID, open: true) { id } }"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (
            {
                "query": QUERY,
                "variables": {"team": "{team_id}", "first": 50, "after": None, "status": "paid", "include_archived": False, "workspace_id": "12345678"},
                "operationName": "Bills",
            },
            True,
        ), ({"query": "query { x }"}, True), ({"query": "{ x }"}, False), ({"query": "mutation { x }"}, False), ({"query": "query { x } mutation { y }"}, False), ({"query": "query { x } # mutation"}, True),
        ({"query": 'query { x(a: "b") }'}, False), ({"query": "query { x(a: 12345) }"}, False), ({"query": "query { x(a: {b: 1}) }"}, False), ({"query": "query { x(a: [1]) }"}, False), ({"query": "query { x(a: PAID1) }"}, False), ({"query": QUERY, "extensions": {}}, False), (
            {"query": QUERY, "operationName": 1}, False,
        ), ({"query": QUERY, "variables": None}, False), ([QUERY], False), ({}, False),
        ({"query": QUERY, "variables": {"a": {"b": {"limit": 5}}}}, True), ({"query": QUERY, "variables": json.loads('{"a":' * 9 + "{}" + "}" * 9)}, False), ({"query": QUERY, "variables": json.loads('{"a":' * 8 + "{}" + "}" * 8)}, True), (
            {"query": QUERY, "variables": {f"a{i}": {f"b{j}": {} for j in range(10)} for i in range(19)}}, False,
        ), ({"query": QUERY, "variables": {f"a{i}": {} for i in range(51)}}, False),
        ({"query": QUERY, "variables": {"limit": 501}}, False), ({"query": QUERY, "variables": {"limit": True}}, False), ({"query": QUERY, "variables": {"ids": []}}, False), ({"query": QUERY, "variables": {"accessToken": "{t}"}}, False), (
            {"query": QUERY, "variables": {"status": "two words"}}, False,
        ), ({"query": QUERY, "variables": {"a b": 1}}, False), ({"query": QUERY, "variables": {"team_id": "abc"}}, False), ({"query": QUERY + " " * 50_000}, False),
    ],
)
def test_read_only_queries(body, want):
    assert graphql.is_read_only(json.dumps(body)) is want


def test_read_only_requests(spark):
    good = json.dumps({"query": QUERY})
    rows = [
        ("POST", HEADERS, good), ("GET", HEADERS, good), ("POST", [], good), ("POST", HEADERS * 2, good),
        ("POST", [("accept", "application/json")], good), ("POST", HEADERS, "{"), (None, None, None), ("POST", HEADERS, good + " " * 70_000),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, method string, headers array<struct<name:string,value:string>>, body string")
    assert [
        r["ok"] for r in df.select("i", graphql.read_only(F.col("method"), F.col("headers"), F.col("body")).alias("ok")).orderBy("i").collect()
    ] == [True] + [False] * 7


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (
            "https://a.se/x#settings/Billing", "https://a.se/x#settings/Billing",
        ), ("https://a.se/x?q=1#billing", "https://a.se/x"), ("https://a.se/#/invoices/12", "https://a.se/#/invoices/12"), ("https://a.se/#billing?x", "https://a.se/"), ("https://a.se/#billing/cancel", "https://a.se/"),
        ("https://a.se/#billing/12345678", "https://a.se/"), ("https://a.se/#top", "https://a.se/"), ("https://a.se/#billing/ö", "https://a.se/"), (
            "https://a.se/#" + "a/" * 120 + "billing", "https://a.se/",
        ), ("http://a.se/#billing", None),
    ],
)
def test_entry_fragments(spark, url, want):
    assert spark.range(1).select(policy.entry_url(F.lit(url))).first()[0] == want
