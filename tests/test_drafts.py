"""Drafts of recipes from captured sessions, and what they give when they are run again."""

import json

from billsift.operators import drafts

JS, HTML = "application/json", "text/html; charset=utf-8"
TEAM = "team_0000000000000001"


def drafted(spark, *sessions):
    rows = [(str(s), p, *e) for s, entries in enumerate(sessions) for p, e in enumerate(entries)]
    df = spark.createDataFrame(
        rows, "session string, pos long, url string, method string, status int, content_type string, request_body string, response_body string",
    )
    origins = spark.createDataFrame([(str(s), "https://e.se") for s in range(len(sessions))], "session string, origin string")
    found = drafts.drafts(df, origins)
    refs, bad = drafts.replayed(found, df)
    return {r["session"]: r for r in found.collect()}, sorted(map(tuple, refs.collect())), sorted(map(tuple, bad.collect()))


def get(url, body, kind=JS, status=200, method="GET", sent=None):
    return (url, method, status, kind, sent, body if isinstance(body, str) else json.dumps(body))


def test_a_listing_with_all_parts(spark):
    invoices = [
        {
            "id": f"in_{i}", "created": 1744158410 + 86400 * i, "amount_due": 2050 + i, "currency": "usd", "lines": [{"id": 1}],
            "invoice_pdf": f"/invoice/x/{i}/pdf",
        } for i in range(3)
    ]
    one = [
        get("https://e.se/api/me", {"user": {"id": 1}}), get("https://e.se/teams", {"teams": [{"team_id": TEAM}]}), get(
            "https://e.se/menu", {"items": [{"id": 1, "date": "2024-01-01"}]},
        ),
        get(
            f"https://e.se/api/{TEAM}/invoices?cursor=a&limit=10", {"data": invoices, "next_cursor": "b", "has_more": True},
        ), get("https://e.se/bad", "{"), get("https://e.se/err", {"data": invoices * 9}, status=500),
    ]
    two = [
        get(
            "https://e.se/graphql",
            {
                "data": {
                    "x": {
                        "edges": [
                            {"node": {"number": "7", "issuedAt": "2024-03-05", "total": "12.50"}},
                            {"node": {"number": " ", "issuedAt": "2024-03-06", "total": "1"}}, {"cursor": "z"},
                        ]
                    }
                }
            },
            method="POST", sent='{"query":"query { x }"}',
        )
    ]
    found, refs, bad = drafted(spark, one, two)
    a, b = found["0"], found["1"]
    assert (
        a["pos"], a["items"], a["id"], a["date"], a["epoch"], a["total"], a["minor"], a["currency"], a["upper"], a["document"],
    ) == (3, "data", "id", "created", "s", "amount_due", True, "currency", True, "invoice_pdf")
    assert a["request"] == "https://e.se/api/{team_id}/invoices?cursor={cursor}&limit=10" and [tuple(c) for c in a["config"]] == [("team_id", 1, "teams.0.team_id")]
    assert (
        a["paginate"], a["cursor"], a["has_more"], a["probe"], a["confidence"], a["identity"],
    ) == ("cursor", "next_cursor", "has_more", "https://e.se/api/me", "high", "explicit_field")
    assert (b["items"], b["prefix"], b["id"], b["total"], b["minor"], b["request_body"], b["confidence"]) == (
        "data.x.edges", "node.", "node.number", "node.total", False, '{"query":"query { x }"}', "low",
    )
    assert refs == [
        ("0", i, f"in_{i}", f"2025-04-{9 + i:02d}", f"20.{50 + i}", "USD", f"https://e.se/invoice/x/{i}/pdf") for i in range(3)
    ] + [("1", 0, "7", "2024-03-05", "12.50", None, None)]
    assert bad == [("1", 1), ("1", 2)]


def test_pages_fall_behind_answers_and_dates_stand_in_for_ids(spark):
    blob = lambda rows: f'<p>x<script type="application/json">{{"a":[</script><script type="application/ld+json">{json.dumps({"list": rows})}</script>'
    rows = [{"issued_on_date": f"2024-01-0{i}", "price": 5.5} for i in range(1, 5)]
    found, refs, _ = drafted(
        spark, [
            get("https://e.se/p", blob(rows), HTML), get("https://e.se/api", {"x": rows[:1]}),
        ], [get("https://e.se/p", blob(rows), HTML)], [get("https://e.se/p", "<p>none", HTML)],
        [get("https://e.se/q/REDACTED/list", {"x": rows})], [
            get("https://e.se/x", {"x": [{"id": 1, "name": "n"}], "y": [{"date": "2024-01-01", "total": 1}, {}, {}]})
        ], [get("https://e.se/z", {"deep": {"a": {"b": {"c": {"d": {"e": {"f": rows}}}}}}})],
    )
    assert set(found) == {"0", "1"}
    assert (found["0"]["source"], found["0"]["pos"], found["0"]["identity"], found["0"]["id"]) == ("json", 1, "date_fallback", "issued_on_date")
    assert (found["1"]["source"], found["1"]["items"], found["1"]["script"], found["1"]["paginate"], found["1"]["minor"]) == ("html", "list", 0, None, False)
    assert [r for r in refs if r[0] == "1"] == [("1", i, f"2024-01-0{i + 1}", f"2024-01-0{i + 1}", "5.5", None, None) for i in range(4)]


def test_hosted_documents(spark):
    rows = [{"id": 1, "date": "2024-01-01", "hosted_url": "https://invoice.stripe.com/i/acct/x?s=1"}]
    found, refs, _ = drafted(spark, [get("https://e.se/x", {"x": rows})])
    assert found["0"]["hosted"] and refs == [("0", 0, "1", "2024-01-01", None, None, "https://pay.stripe.com/invoice/acct/x/pdf?s=1")]


def test_candidates_in_order(spark):
    draft = spark.createDataFrame(
        [("a", "json", "explicit_field", "x", "u", 3), ("b", "html", "date_fallback", "x", "u", 3), ("c", "html", "explicit_field", "x", "u", 3)],
        "session string, source string, identity string, items string, request string, n_items int",
    )
    links = spark.createDataFrame([("a", "p", 700), ("b", "p", 0), (None, "p", 2)], "session string, url string, n_links int")
    controls = spark.createDataFrame(
        [("a", "p", 5, 1), ("b", "p", 0, 2), ("c", "p", 0, 0), (None, "p", 9, 9)], "session string, url string, n_controls int, n_sections int",
    )
    got = sorted((str(r["session"]), r["place"], r["adapter"], r["preview"]) for r in drafts.compiled(draft, links, controls).collect())
    assert got == [
        ("None", 3, "dom-links", 2), ("a", 1, "network-json", 3), ("a", 3, "dom-links", 500), ("b", 4, "dom-actions", 1),
        ("c", 2, "embedded-json", 3),
    ]
