"""Evidence within bounds, bounded files, PDF identity, locale order, safe patterns."""

import re
import time

import pytest
from pyspark.sql import functions as F

from billsift.functions import content, values
from billsift.operators import identity, ranking
from billsift.plans import recipe
from billsift.sources import ingest

O = "https://e.se"


def evidence(spark, **given):
    page = dict(expected=O, origin=O, url=O + "/x", title="t", application=None, site="s", html="<p>", hosts=[], resources=[], links=[], counts={}) | given
    schema = "expected string, " + ingest.EVIDENCE
    row = tuple(page[f.split()[0]] for f in ["expected", *[x for x in re.split(r", (?=\w+ )", ingest.EVIDENCE)]])
    return spark.createDataFrame([row], schema)


def res(path="/r", body="b", origin=O, status=200, method="GET", sent=None, kind="text/html"):
    return (origin + path, status, kind, body, method, sent)


def told(df, **options):
    pages, seen = ingest.bounded(df, "expected", **options)
    rows = pages.collect()
    return rows[0] if rows else None, seen.get


def test_evidence_is_bounded_and_counted(spark):
    page, seen = told(evidence(
        spark, title="t" * 161, site=None, html=None, hosts=[
            "cdn.se", "localhost", "cdn.se", "a:1", "x" * 254, None, "d.se", "e.se", "f.se",
        ], counts={"a": 5, "b": 1001, "c": -1},
        resources=[
            res(), res(status=600), res(origin="https://cdn.se"), res(origin="https://evil.se"), res("/r#x"), res(body=None), res(method="PUT"),
            res(sent="x" * 65_537), res(origin="http://e.se"), res(method=None), res(kind="x" * 257),
        ],
        links=[
            (O + "/a?page=2&q=1", " a \n b ", None), ("https://f.se/a", None, None), (O + "/logout", None, None), (O + "/b", "x" * 161, None),
            (O + "/b", None, "x" * 241), (None, None, None),
        ],
    ))
    assert page["title"] is None and page["html"] == "" and page["hosts"] == ["cdn.se", "d.se", "e.se"] and page["counts"] == {"a": 5, "b": 0, "c": 0}
    assert [r["url"] for r in page["resources"]] == [O + "/r", "https://cdn.se/r", O + "/r"] and [tuple(x) for x in page["links"]] == [(O + "/a?page=2", "a b", None)]
    want = dict(names=1, html=1, hosts=5, resources=8, bodies=0, links=5, counts=2)
    assert page["dropped"].asDict() == want and seen == want | {"refused": 0}


def test_bodies_share_a_budget_and_later_ones_may_fit(spark):
    page, seen = told(
        evidence(spark, resources=[res(f"/{i}", "x" * n) for i, n in enumerate((256_000, 256_000, 200_000, 100_000, 256_000, 56_000, 256_001, 1))]),
        resources=7,
    )
    assert [r["url"][-1] for r in page["resources"]] == ["0", "1", "2", "5"] and page["dropped"]["bodies"] == 2 and page["dropped"]["resources"] == 2 and seen["bodies"] == 2


@pytest.mark.parametrize(
    "bad",
    [
        {"origin": "https://f.se"}, {"url": "http://e.se/x"}, {"url": "https://f.se/x"}, {"url": "https://u@e.se/x"}, {"url": None},
        {"url": O + "/" + "x" * 2048},
    ],
)
def test_other_pages_are_refused(spark, bad):
    page, seen = told(evidence(spark, title="t" * 161, **bad))
    assert page is None and seen["refused"] == 1 and seen["names"] == 0


def test_missing_lists(spark):
    page, _ = told(evidence(spark, hosts=None, resources=None, links=None, counts=None))
    assert page["dropped"].asDict() == dict(names=0, html=0, hosts=1, resources=1, bodies=0, links=1, counts=0)


def test_long_files_are_never_opened(spark, tmp_path):
    for name, size in (("a.pdf", 10), ("b.pdf", 11), ("c.txt", 1)):
        (tmp_path / name).write_bytes(b"%PDF-" + b"x" * (size - 5) if size > 5 else b"x")
    bodies, refused = ingest.bounded_files(spark, str(tmp_path), 10, "*.pdf")
    assert [(r["path"].rpartition("/")[2], r["length"], len(r["content"])) for r in bodies.collect()] == [("a.pdf", 10, 10)]
    assert [(r["path"].rpartition("/")[2], r["length"]) for r in refused.collect()] == [("b.pdf", 11)]
    plan = bodies._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*LessThanOrEqual\(length,10\)", plan)


def test_pdf_identity():
    make = lambda date=b"D:20240101", id_=b"<0123456789abcdef> <0123456789abcdef>", link=b"a/b", body=b"/ModDate (D:1234)": b"%PDF-1.4\n/CreationDate (" + date + b")\r/ID[" + id_ + b"] /URI (https://invoice.stripe.com/i/" + link + b")\nstream \r\n" + body + b"\nendstream\n/ModDate(D:12345)"
    same = content.canonical(make())
    assert same == content.canonical(make(b"D:20250101120000Z", b"<00000000000000000000> <11111111111111111111>", b"c"))
    assert same == b"%PDF-1.4\n/CreationDate (D:VOLATILE)\r/ID [<VOLATILE> <VOLATILE>] /URI (https://invoice.stripe.com/i/VOLATILE)\nstream \r\n/ModDate (D:1234)\nendstream\n/ModDate (D:VOLATILE)"
    assert same != content.canonical(make(body=b"/ModDate (D:1235)"))
    for odd in (make(b"20240101"), make(b"D:123"), make(id_=b"<01> <02>")):
        assert content.canonical(odd) != same
    for raw in (make().replace(b"endstream", b"endstreams"), b"PDF" + make(), make().replace(b"%PDF-", b"%PDF "), b"%PDF-" + b"x" * 10, b""):
        assert content.canonical(raw) == raw
    start = time.time()
    content.canonical(b"%PDF-" + b"/ID [" * 400_000)
    content.canonical(b"%PDF-" + b"\nstream\nx\nendstream\n/ID[<0123456789abcdef><0123456789abcdef>]" * 50_000)
    assert time.time() - start < 20


def test_key_repairs(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None), ("a", "x")], "key string, content_key string")
    accepted = spark.createDataFrame([("x",), ("a",), (None,)], "key string")
    assert [r["key"] for r in identity.repaired(docs, accepted).collect()] == ["b"]


def test_locale_order(spark):
    names = ["z", "a", "ä", "A", "å", "Z", "_y", "É", "e", "f", "-x", "b", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r["name"]: r["place"] for r in ranking.in_locale_order(df, "name").collect()}
    assert sorted(found, key=found.get) == [None, "", "_y", "-x", "a", "A", "å", "ä", "b", "e", "É", "f", "z", "Z"]
    targets = spark.createDataFrame(
        [(1, u, "link", "f", 5) for u in ("/b", "/B", "/a", "/ä", "/z")], "k int, url string, source string, family string, score int",
    )
    assert [r["url"] for r in ranking.frontier(targets, ["k"]).orderBy("rank").collect()] == ["/a", "/ä", "/b", "/B", "/z"]
    assert spark.range(1).select(values.locale(F.lit("a")) < values.locale(F.lit("B"))).first()[0]


SAFE = [
    "a+b?", "(?:ab)+c", "(a|b)c*", r"(?<id>\d{1,9})-(?:x|y)?", "[(a+)]*b", r"\(a+\)*", "(?:[a-z+*])+", "((a))*", "x{100}", "a{2,}b{3,5}",
    "(?:a|b){3}", "R+(R)*",
]
UNSAFE = [
    "(a+)+", "(?:a+b?)*", "(a|a)*b", "(?:a|ab)*c", "((a+))*", "(?:(?:a?)b)+", "(a{2}){1,}", "(x(y|z)w){2,}", "a{101}", "a{1,101}", r"(a)\1", "(?=a)",
    "(?<!a)b", "(", "", "a" * 201, r"(?<n>a*)+", "(?:\\d+|[a]){3,}",
]


@pytest.mark.parametrize("pattern", SAFE)
def test_linear_patterns_are_kept(pattern):
    recipe.check_pattern(pattern)


@pytest.mark.parametrize("pattern", UNSAFE)
def test_other_patterns_are_refused(pattern):
    with pytest.raises(recipe.RecipeError):
        recipe.check_pattern(pattern)
