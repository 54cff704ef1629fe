"""Registered queries of the ledger, the seen store, deliveries, and scans of bodies, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import transforms, values
from .operators import evidence, ledger
from .queries import query, table
from .queries_tracing import by, text
from .session import shared_dir
from .sources import scans, sinks


@query("""
WITH a AS (SELECT o_custkey, 'k' || (o_orderkey % 12) AS key, 'd' || (o_orderkey % 2) AS d, 's' || (o_orderkey % 5 // 4) AS s, o_orderkey AS t FROM orders),
one AS (SELECT o_custkey, key, arg_min(d, (t, d)) AS d, arg_min(s, (t, d)) AS s, min(t) AS t FROM a WHERE t % 2 = 0 GROUP BY 1, 2),
    two AS (SELECT o_custkey, key, arg_min(d, (t, d)) AS d, arg_min(s, (t, d)) AS s, min(t) AS t FROM a WHERE t % 2 = 1 OR t % 3 = 0 GROUP BY 1, 2)
SELECT two.o_custkey::VARCHAR AS owner, two.key AS identity, NOT coalesce(one.d = two.d AND one.s <> two.s, false) AS accepted, coalesce(one.d = two.d
    AND one.s = two.s, false) AS deduped, CASE WHEN one.d = two.d AND one.s <> two.s THEN 'supplier' END AS why FROM two LEFT
    JOIN one USING (o_custkey, key)""")
def delivery_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders delivered in two batches of a new sink in the shared folder: receipts of the second, after the first and a lost try of the second."""
    key = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("owner"), text("k", key % 12).alias("key"), text("s", F.floor(key % 5 / 4)).alias("source"), text("d", key % 2).alias("destination"), text(
            "d", key % 2, "/", F.lpad(key.cast("string"), 9, "0"),
        ).alias("path"), key.alias("updated"), "o_totalprice",
    )
    root = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    sinks.deliver(docs.where("updated % 2 = 0"), root, 1)
    second = docs.where("updated % 2 = 1 OR updated % 3 = 0")
    sinks.deliver(second, root, 2)
    return sinks.deliver(second, root, 2)


@query("""
WITH e AS (SELECT user_id, event_id, event_type = 'signup' AS held, row_number() OVER (PARTITION BY user_id, event_type = 'signup' ORDER BY ts DESC,
    event_id DESC) AS k FROM events)
SELECT user_id, event_id, held FROM e WHERE held OR k <= 20""")
def seen_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's 20 latest keys; reservations are not counted and stay."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("held"))
    return ledger.newest(rows, [F.col("ts").desc(), F.col("event_id").desc()], 20, ["user_id"], F.col("held")).select("user_id", "event_id", "held")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS d, o_orderdate + INTERVAL 36 HOUR AS c FROM orders)
SELECT o_orderkey, CASE WHEN d IS NOT NULL THEN d BETWEEN DATE '1998-05-16' AND DATE '1998-06-15' ELSE c BETWEEN TIMESTAMP '1998-05-16'
    AND TIMESTAMP '1998-06-15 12:00:00' END AS last_30d, CASE WHEN d IS NOT NULL THEN d BETWEEN DATE '1998-01-01' AND DATE '1998-06-15'
    ELSE c BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-15 12:00:00' END AS this_year FROM o""")
def ledger_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders has no date, so when they were collected counts."""
    day = F.when(F.col("o_orderkey") % 3 > 0, F.to_date("o_orderdate"))
    collected = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 36 HOURS")
    today, now = F.lit("1998-06-15").cast("date"), F.lit("1998-06-15 12:00:00").cast("timestamp")
    flags = {"last_30d": "30d", "this_year": "year"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[ledger.in_range(day, today, r, collected, now).alias(n) for n, r in flags.items()])


@query("""
WITH e AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE END AS d,
    TIMESTAMP '2024-01-01' + to_minutes(o_orderkey) AS c FROM orders),
g AS (SELECT o_custkey, row_number() OVER (ORDER BY max(c) DESC) AS group_place FROM e GROUP BY 1)
SELECT o_orderkey, group_place, row_number() OVER (PARTITION BY e.o_custkey ORDER BY coalesce(d::TIMESTAMP, c) DESC, c DESC) AS place FROM e
    JOIN g USING (o_custkey)""")
def ledger_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", text("c", F.col("o_custkey")).alias("name"), F.when(key % 4 > 0, F.to_date("o_orderdate")).alias("issued"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=key.cast("int"))).alias("collected"),
    )
    return ledger.supplier_groups(rows, "o_custkey", "name", "collected", "issued").select("o_orderkey", "group_place", "place")


@query("""
SELECT o_orderkey, CASE WHEN k < 8 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'on ' || o_orderkey END AS day FROM (SELECT *, o_orderkey % 9 AS k
    FROM orders)""")
def dates_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as bodies have them: ISO with and without a time, with slashes, with a month's name, as a mail's header; and what is none."""
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'T10:00:00Z'", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "EEE, d MMM yyyy '10:00:00 GMT'")
    shown = by(F.col("o_orderkey"), *[F.date_format("o_orderdate", f) for f in forms], text("on ", F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", transforms.dated(shown).alias("day"))


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS o, html FROM pages)
SELECT page_id, [o || '/c/' || page_id || '?x=../y', o || '/', o || '/a/d#./e', o || '/a/' || page_id || '/',
    o || '/f', 'https://z.example.com/g'][page_id % 6 + 1] AS url FROM p""")
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with dot segments, from a page two folders down."""
    id = F.col("page_id")
    link = by(
        id, text("../../c/./", id, "?x=../y"), text("/../.."), text("../d#./e"), text("../", id, "/x/.."), text("/b/%2E%2e/f"),
        text("//z.example.com/h/../g"),
    )
    origin = F.lower(F.regexp_extract("url", "^(https?://[^/?#]+)", 1))
    shown = scans.absolute(link, text(origin, "/a/b/page?q=1"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(id % 6 == 5, F.regexp_replace(shown, "^http:", "https:")).otherwise(shown).alias("url"))


@query("""
WITH t AS (SELECT page_id, nullif(substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), 1,
    160), '') AS title, url FROM pages WHERE html IS NOT NULL)
SELECT page_id, title, CASE WHEN page_id % 3 = 0 THEN 'App ' || page_id END AS application, CASE WHEN page_id % 2 = 0 THEN substr(repeat(url, 20), 1,
    160) END AS site FROM t""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose heads were given names of their own."""
    id = F.col("page_id")
    head = F.concat(
        F.when(id % 3 == 0, text("<meta content='App ", id, "' name=\"application-name\">")).otherwise("<meta name=\"application-names\" content=\"x\">"),
        F.when(
            id % 2 == 0, text('<META property="og:site_name" content="', F.repeat("url", F.lit(20)), '"/>'),
        ).otherwise('<meta property="og:title" content="y">'),
    )
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.concat("html", head).alias("html"))
    return pages.select("page_id", scans.page_names(F.col("html")).alias("n")).select("page_id", "n.*")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER - 1 AS pos, 'o' || o_orderkey AS id,
    round(o_totalprice * 100)::BIGINT::VARCHAR AS total FROM orders WHERE o_custkey % 4 > 0""")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of orders in JSON bodies; a fourth of the bodies is broken or has no list."""
    item = F.struct(
        text("o", F.col("o_orderkey")).alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total"), F.col("o_orderkey").alias("n"),
    )
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), item.alias("item")))), lambda x: x["item"]).alias("items")
    )
    body = F.when(
        F.col("o_custkey") % 4 > 0, text('{"data":{"0":{"rows":', F.to_json("items"), "}}}"),
    ).when(F.col("o_custkey") % 8 == 0, text('{"data":{"0":{"rows":', F.to_json("items"))).otherwise('{"data":{"0":{"rows":{}}}}')
    found = scans.json_items(listed.select("o_custkey", body.alias("body")), "body", "data.0.rows")
    return found.select(
        scans.at_path(F.col("item"), "n", "bigint").alias("o_orderkey"), "pos", scans.at_path(F.col("item"), "id").alias("id"),
        scans.at_path(F.col("item"), "total").alias("total"),
    )


@query("""
WITH c AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 14, '0') AS b FROM customer),
k AS (SELECT *, 98 - ((b || '131400')::HUGEINT % 97) AS rest FROM c)
SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'DE' || lpad(rest::VARCHAR, 2, '0') || b END AS iban FROM k""")
def iban_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers as account numbers with right check digits, plain or in groups of four; a third has wrong ones."""
    key = F.col("c_custkey")
    digits = F.lpad(key.cast("string"), 14, "0")
    check = 98 - F.concat(digits, F.lit("131400")).cast("decimal(20,0)") % 97
    right = F.lpad(check.cast("int").cast("string"), 2, "0")
    wrong = F.lpad(((check + 1) % 97 + 1).cast("int").cast("string"), 2, "0")
    plain = text("DE", F.when(key % 3 < 2, right).otherwise(wrong), digits)
    shown = F.when(key % 3 == 1, F.trim(F.regexp_replace(plain, "(.{4})", "$1 "))).otherwise(plain)
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(values.ibans(text("pay to ", shown, ", soon")), F.lit(0)).alias("iban"))


@query("""
WITH p AS (SELECT page_id, page_id % 3 < 2 AS about, page_id::VARCHAR AS i FROM pages),
l AS (SELECT page_id, about, unnest([0, 1, 2, 4, 7]) AS k, unnest(['https://e.com/files/' || i || '.pdf', 'https://e.com/invoices/' || i || '.pdf', 'https://e.com/x/' || i, 'https://invoice.stripe.com/i/acct/' || i,
  'https://e.com/y/' || i]) AS link, unnest(['Open', 'Open it', 'Receipt', 'View', 'Open']) AS label FROM p)
SELECT page_id, link, label, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS pos FROM l WHERE about OR k IN (1, 2, 4)""")
def document_link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title or caption is about payments, or neither, with links of nine kinds."""
    i = F.col("page_id")
    html = text(
        "<title>", F.when(i % 3 == 0, "Past  payments").otherwise("Home"), "</title><table><caption>", F.when(i % 3 == 1, "<b>Transactions</b>").otherwise("x"), "</caption>",
        '<a href="/files/', i, '.pdf">Open</a><a class="z" href="/invoices/', i, '.pdf"><b>Open</b> it</a><a href="/x/', i, '" download>Receipt</a><a href="/z/', i, '" data-download="1">Receipt</a>',
        '<a href="https://invoice.stripe.com/i/acct/', i, '">View</a><a href="/guide/', i, '/help.pdf">Invoice</a><a href="http://e.com/invoice/', i, '.pdf">I</a><a href="/y/', i, '" title="Download it">Open<a href="/invoices/', i, '.pdf">again</a>',
    )
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"), F.lit("https://e.com/invoices/home").alias("base"))
    return scans.document_links(pages, "html", "base").select("page_id", "link", "label", "pos")


@query("""
WITH c AS (SELECT user_id, event_type AS v, CASE WHEN value > 60 THEN 3 ELSE 1 END AS w, row_number() OVER (PARTITION BY user_id ORDER BY value > 60 DESC, event_id) AS k FROM events),
g AS (SELECT user_id, v, max(w) AS w, count(*) AS n FROM c WHERE k <= 32 GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY w DESC, n DESC) AS k FROM g)
SELECT user_id, CASE WHEN count(*) = 1 THEN min(v) END AS value, count(*) > 1 AS conflict FROM r WHERE k = 1 GROUP BY 1""")
def bounded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as evidence of which the first 32 count, the certain ones first."""
    high = F.col("value") > 60
    claims = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("value"), F.when(high, 3).otherwise(1).alias("weight"))
    kept = evidence.bounded_claims(claims, ["user_id"], [F.desc("weight"), F.asc("event_id")])
    return evidence.resolve(kept, ["user_id"]).select("user_id", "value", "conflict")


@query("SELECT event_id, CASE WHEN user_id * 1000 + event_id % 977 > 70000 AND user_id * 1000 + event_id % 977 <= 156700 THEN user_id * 1000 + event_id % 977 END AS at_s FROM events")
def eligible_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.col("user_id") * 1000 + F.col("event_id") % 977
    return table(spark, sf_dir, "events").select("event_id", values.eligible_at(until, F.lit(70_000)).alias("at_s"))


@query("""
WITH f AS (SELECT user_id, event_id % 2 AS side, min(ts) AS seen, list(DISTINCT event_type || (event_id % 9)) AS s, max(value) FILTER (value < 70) AS v FROM events GROUP BY 1, 2),
a AS (SELECT * FROM f WHERE side = 0), b AS (SELECT * FROM f WHERE side = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, epoch_us(least(a.seen, b.seen)) AS seen, coalesce(b.v, a.v) AS v,
  least(len(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))), 32)::VARCHAR AS n FROM a FULL JOIN b ON a.user_id = b.user_id""")
def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's even events as stored entries, the odd ones as what comes in: new values win, the earlier time stays, lists are joined without repeats, 32 at most."""
    kind = F.concat("event_type", (F.col("event_id") % 9).cast("string"))
    side = lambda k: table(spark, sf_dir, "events").where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.min("ts").alias("seen"), F.array_sort(F.collect_set(kind)).alias("s"), F.max(F.when(F.col("value") < 70, F.col("value"))).alias("v"))
    merged = ledger.upsert(side(0), side(1), ["user_id"], ["seen"], ["s"])
    return merged.select("user_id", F.unix_micros(F.col("seen").cast("timestamp")).alias("seen"), "v", F.size("s").cast("string").alias("n"))
