"""Registered queries of what requests and responses tell of each other, over bodies made of the tables' values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import policy
from .operators import drafts, tracing
from .operators.numbering import written
from .queries import query, table
from .sources import graphql


def text(*parts: str | Column) -> Column:
    """Parts of a text; columns in it are written as texts."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def by(number: Column, *choices: Column) -> Column:
    """The choice of a number modulo their count."""
    return F.get(F.array(*choices), (number % len(choices)).cast("int"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 6 AS kind, c_mktsegment AS s, c_nationkey AS n FROM customer)
SELECT c_custkey, ['cursor', 'next-url', 'offset', 'page'][kind + 1] AS kind, CASE kind WHEN 0 THEN s || '.meta.next_cursor'
    WHEN 1 THEN s || '.links.next' END AS path,
  CASE kind WHEN 0 THEN s || '.hasMore' WHEN 2 THEN 'a.' || s || '.hasMore' WHEN 3 THEN 'has_more' END AS more,
  CASE WHEN kind = 2 THEN CASE WHEN n = 0 THEN 50 ELSE n END END::INTEGER AS step, CASE WHEN kind = 2 THEN CASE WHEN n = 0 THEN 50 ELSE n END
      WHEN kind = 3 AND n > 0 THEN n END::INTEGER AS page_size
FROM c WHERE kind < 4""")
def pagination_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of every kind, each with two flags, under names and sizes of the customer's own; two kinds say nothing."""
    key, name, size = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey")
    asked = by(key, text("cursor=x"), text(""), text("offset=20&limit=", size), text("p=2&page_size=", size), text("q=1"), text("page=1"))
    body = by(
        key, text('{"data":{"has_more":false},"', name, '":{"meta":{"next_cursor":"c', key, '"},"hasMore":1}}'), text(
            '{"has_more":true,"', name, '":{"links":{"next":"/p/', key, '"},"hasMore":true},"cursor":"c"}',
        ),
        text('{"a":{"', name, '":{"hasMore":"yes"}},"has_more":true}'), text('{"has_more":false,"', name, '":{"has_next_page":true}}'), text(
            '{"cursor":"c","has_more":true,"', name, '":{"hasMore":true}}',
        ), text('{"', name, '":[{"has_more":true,"hasMore":true}]}'),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", text("https://e.com/api?", asked).alias("url"), body.alias("body"))
    return tracing.pagination(rows, ["c_custkey"], "url", "body")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS kind, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders),
a AS (SELECT o_custkey, min(((CASE kind WHEN 0 THEN -5 ELSE -3 END), o_orderkey)) AS b FROM o WHERE o_orderkey < last AND kind IN (0, 3) GROUP BY 1),
c AS (SELECT o_custkey, min(o_orderkey) AS b FROM o WHERE o_orderkey < last AND kind = 2 GROUP BY 1)
SELECT o_custkey, 'acct' || lpad(o_custkey::VARCHAR, 16, '0') AS token, 'url' AS location, 'account_id' AS config_id, b[2] AS source, CASE b[1]
    WHEN -5 THEN 'user.accountId' ELSE 'org.id' END AS path FROM a
UNION ALL SELECT o_custkey, 'acct' || lpad(o_custkey::VARCHAR, 16, '0'), 'url', 'account_id', b, 'ids.0' FROM c WHERE o_custkey NOT IN (SELECT o_custkey FROM a)
UNION ALL SELECT o_custkey, 'team_' || lpad(o_custkey::VARCHAR, 16, '0'), 'body', 'team', b, 'team.ref' FROM c""")
def id_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a session; the last asks for a listing with two ids. One kind of response is an echo, one names an id by itself."""
    key, pad = F.col("o_orderkey"), F.lpad(F.col("o_custkey").cast("string"), 16, "0")
    account, team = text("acct", pad), text("team_", pad)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("pos"))
    entries = orders.select(
        "o_custkey", key.alias("pos"), by(
            key, text("https://e.com/me"), text("https://e.com/x/", account), text("https://e.com/list"), text("https://e.com/t"),
        ).alias("url"), F.lit(None).cast("string").alias("request_body"), F.lit("application/json").alias("content_type"),
        by(
            key, text('{"user":{"accountId":"', account, '"}}'), text('{"account_id":"', account, '"}'),
            text('{"ids":["', account, '"],"team":{"ref":"', team, '"}}'), text('{"', team, '":{"id":"', team, '"},"org":{"id":"', account, '"}}'),
        ).alias("response_body"),
    )
    ends = last.select(F.col("o_custkey").alias("_k"), F.col("pos").alias("_last"))
    asks = (F.col("o_custkey") == F.col("_k")) & (F.col("pos") == F.col("_last"))
    listing = F.col("_last").isNotNull()
    entries = entries.join(ends, asks, "left").withColumns({
        "url": F.when(
            listing, text("https://e.com/invoices?account_id=acct", pad),
        ).otherwise(F.col("url")), "request_body": F.when(listing, text('{"variables":{"team":"team_', pad, '"}}')),
    }).drop("_k", "_last")
    return tracing.provenance(entries, last, "o_custkey")


@query("""
WITH o AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderkey % 4 IN (0, 3)) AS source FROM orders GROUP BY 1)
SELECT c_custkey, 'https://app.e.com/w/{' || CASE source % 4 WHEN 0 THEN 'team_id' ELSE 'account' END || '}/home' AS open_url, CASE source % 4
    WHEN 0 THEN 'team_id' ELSE 'account' END AS scope, CASE source % 4 WHEN 0 THEN 'team_id' ELSE 'account.id' END AS path, source
FROM customer JOIN o ON o_custkey = c_custkey WHERE c_custkey % 5 > 0 AND source IS NOT NULL
UNION ALL SELECT c_custkey, 'https://app.e.com/team/' || (10000000 + c_custkey) || '/billing', NULL, NULL, NULL FROM customer WHERE c_custkey % 5 = 0""")
def tenant_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's page with its number in the address, and its orders as responses: two kinds give it, one deeper than the other, one is no query, one asks for it itself."""
    tenant, key = (10_000_000 + F.col("c_custkey")).cast("string"), F.col("o_orderkey")
    own = (10_000_000 + F.col("o_custkey")).cast("string")
    pages = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(
            F.col("c_custkey") % 5 > 0, text("https://app.e.com/w/", tenant, "/home"),
        ).otherwise(text("https://app.e.com/team/", tenant, "/billing")).alias("url"),
        F.array(F.lit("api.e.com")).alias("hosts"),
    )
    bodies = by(
        key, text('{"x":{"workspace":{"id":"', own, '"}},"team_id":"', own, '"}'), text('{"team_id":"', own, '"}'), text('{"team_id":"', own, '"}'),
        text('{"list":[{"team_id":"', own, '"}],"account":{"id":', own, ',"orgId":', own, "}}"),
    )
    resources = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), key.alias("pos"), by(
            key, text("https://app.e.com/a"), text("https://app.e.com/b"), text("https://app.e.com/c?team=", own), text("https://api.e.com/d"),
        ).alias("url"),
        by(
            key, text("GET"), text("POST"), text("GET"), text("GET"),
        ).alias("method"), F.when(key % 4 == 1, "{}").alias("request_body"), F.lit(False).alias("safe_post"), bodies.alias("body"),
    )
    return tracing.tenant_bindings(pages, resources, "c_custkey")


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS kind, o_custkey, o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN o_custkey <= 500 WHEN 1 THEN o_custkey <= 9999
    WHEN 2 THEN regexp_full_match(o_orderpriority, '[A-Za-z][A-Za-z0-9_-]{0,31}') WHEN 3 THEN length((1000000 + o_custkey)::VARCHAR) BETWEEN 7 AND 20
    WHEN 6 THEN o_custkey % 9 > 0 ELSE false END AS kept FROM o""")
def read_only_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that hold the orders' values as counts, literals, choices, ids, strings and names; and how deep their variables go."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    asks = lambda *variables: text('{"query":"query Bills($a: Int) { bills(a: $a, state: PAID) { id } }","variables":{', *variables, "}}")
    deep = (customer % 9 == 0).cast("int") * 9
    bodies = by(
        key, asks('"first":', customer), text('{"query":"query { bills(a: ', customer, ') { id } }"}'), asks('"status":"', F.col("o_orderpriority"), '"'), asks(
            '"team_id":"', (1_000_000 + customer).cast("string"), '"',
        ),
        text('{"query":"query { bills(a: \\"', customer, '\\") { id } }"}'), text('{"query":"mutation { pay(a: ', F.col("o_orderstatus"), ') { id } }"}'), asks(
            F.repeat(F.lit('"a":{'), deep), '"after":null', F.repeat(F.lit("}"), deep),
        ), asks('"token":"{t', customer, '}"'),
    )
    headers = F.array(F.struct(F.lit("content-type").alias("name"), F.lit("application/json").alias("value")))
    return table(spark, sf_dir, "orders").select("o_orderkey", graphql.read_only(F.lit("POST"), headers, bodies).alias("kept"))


_CREDENTIAL = "'(?i)^(?:eyJ[A-Za-z0-9_-]{16,}|[A-Za-z0-9_-]{24,}|[0-9a-f]{32,}|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|\\d{7,})$'"


@query(f"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN ''
    WHEN 1 THEN '/team/' || (10000000 + page_id) || '/billing' ELSE '/team/' || (10000000 + page_id) || '/x' END AS bare,
    CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '?page=' || page_id WHEN 2 THEN '#settings/Billing'
        WHEN 3 THEN '#/invoices/' || page_id || '/' || (1000000 + page_id) ELSE '#/invoices/' || page_id END AS tail, url FROM pages),
s AS (SELECT *, regexp_extract(bare, '^(https://[^/]+)', 1) AS origin, regexp_extract(bare, '^https://[^/]+(/.*)$', 1) AS path FROM p),
g AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM s),
b AS (SELECT *, len(list_filter(seg, lambda x: regexp_matches(x, {_CREDENTIAL}))) AS suspects, list_contains(seg, 'billing') AS billing FROM g)
SELECT page_id, CASE WHEN origin <> '' THEN lower(origin) || CASE WHEN path = '' THEN '/' WHEN suspects > 1 OR (suspects = 1 AND NOT billing) THEN '/'
    ELSE path END
  || CASE WHEN starts_with(tail, '#') AND page_id % 5 <> 3 THEN tail ELSE '' END END AS entry FROM b""")
def entry_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages, some with a tenant's number in their path, with queries and hashes of several kinds."""
    id, number = F.col("page_id"), (10_000_000 + F.col("page_id")).cast("string")
    bare = F.concat(F.regexp_replace("url", "[?#].*$", ""), by(id, text(""), text("/team/", number, "/billing"), text("/team/", number, "/x")))
    tail = by(id, text(""), text("?page=", id), text("#settings/Billing"), text("#/invoices/", id, "/", 1_000_000 + id), text("#/invoices/", id))
    return table(spark, sf_dir, "pages").select("page_id", policy.entry_url(F.concat(bare, tail)).alias("entry"))


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as a session: who is signed in, and a listing as a plain answer, one in envelopes, or a page's data."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    item = F.struct(
        text("ord", key).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"), F.lit("eur").alias("currency"), text("/orders/", key, "/pdf").alias("pdf_url"), F.array(F.struct(key.alias("line_id"))).alias("lines")
    )
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), item.alias("item")))).alias("rows"))
    items, edges = F.to_json(F.transform("rows", lambda r: r["item"])), F.to_json(F.transform("rows", lambda r: F.struct(r["item"].alias("node"))))
    body = by(
        customer, text('{"data":', items, ',"next_cursor":"c","has_more":true}'), text('{"data":{"orders":{"edges":', edges, "}}}"),
        text('<html><script type="application/json">{"x":1}</script><script type="application/json">{"page":{"rows":', items, "}}</script></html>"),
    )
    lists = listed.select(
        F.col("o_custkey").alias("session"), F.lit(1).cast("long").alias("pos"), by(
            customer, text("https://e.com/api/list?cursor=x"), text("https://e.com/graphql"), text("https://e.com/page/", customer),
        ).alias("url"), F.lit("GET").alias("method"), F.lit(200).alias("status"),
        by(
            customer, text("application/json"), text("application/json"), text("text/html"),
        ).alias("content_type"), F.lit(None).cast("string").alias("request_body"), body.alias("response_body"),
    )
    me = lists.select(
        "session", F.lit(0).cast("long").alias("pos"), F.lit("https://e.com/api/me").alias("url"), "method",
        F.when(F.col("session") % 2 == 0, 200).otherwise(404).alias("status"), F.lit("application/json").alias("content_type"), "request_body",
        F.lit('{"user":"x"}').alias("response_body"),
    )
    return written(lists.unionByName(me), "sessions"), listed.select(F.col("o_custkey").alias("session"), F.lit("https://e.com").alias("origin"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, o_custkey % 3 AS kind FROM orders GROUP BY 1)
SELECT o_custkey AS session, ['data', 'data.orders.edges', 'page.rows'][kind + 1] AS items, n::INTEGER AS n_items, (CASE kind WHEN 1 THEN 'node.'
    ELSE '' END) || 'id' AS id, (CASE kind WHEN 1 THEN 'node.' ELSE '' END) || 'amount' AS total, (CASE kind WHEN 1 THEN 'node.'
    ELSE '' END) || 'pdf_url' AS document,
  ['https://e.com/api/list?cursor={cursor}', 'https://e.com/graphql', 'https://e.com/page/' || o_custkey][kind + 1] AS request, CASE kind
      WHEN 0 THEN 'cursor' END AS paginate, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS script, CASE WHEN n >= 2 AND o_custkey % 2 = 0 THEN 'high'
      ELSE 'medium' END AS confidence FROM o""")
def recipe_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.drafts(*_sessions(spark, sf_dir)).select(
        "session", "items", "n_items", "id", "total", "document", "request", "paginate", "script", "confidence",
    )


@query("""
SELECT o_custkey AS session, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS item, 'ord' || o_orderkey AS id,
    strftime(o_orderdate, '%Y-%m-%d') AS issued_at,
  (round(o_totalprice * 100)::BIGINT / 100)::DECIMAL(28,
      2)::VARCHAR AS total, 'EUR' AS currency, 'https://e.com/orders/' || o_orderkey || '/pdf' AS document_url FROM orders""")
def recipe_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts run again over the answers that they were drafted from give every order back."""
    entries, origins = _sessions(spark, sf_dir)
    return drafts.replayed(drafts.drafts(entries, origins), entries)[0]


@query("""
WITH o AS (SELECT o_custkey AS session, count(*) AS n, o_custkey % 3 AS kind, count(*) FILTER (o_orderstatus = 'F') AS f,
    count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1),
c AS (SELECT session, CASE WHEN kind < 2 THEN 'network-json' ELSE 'embedded-json' END AS adapter, CASE WHEN kind < 2 THEN 1 ELSE 2 END AS place,
    n AS preview FROM o
  UNION ALL SELECT session, 'dom-links', 3, f FROM o WHERE f > 0 UNION ALL SELECT session, 'dom-actions', 4, p FROM o WHERE f = 0 AND p > 0)
SELECT session, adapter, place, preview::INTEGER AS preview FROM c""")
def compiled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of sessions beside their finished orders as links and their pending ones as controls."""
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session")).agg(
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_links"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("n_controls"),
    )
    counted = counted.select("session", F.lit("https://e.com/x").alias("url"), "n_links", "n_controls", F.lit(0).alias("n_sections"))
    return drafts.compiled(drafts.drafts(*_sessions(spark, sf_dir)), counted, counted).select("session", "adapter", "place", "preview")
