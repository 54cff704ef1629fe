"""Registered queries of guards, previews, scopes, labels and views, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import guards, labels
from .operators import admission
from .plans import schema
from .queries import query, table
from .queries_tracing import by, text
from .queries_values import _PAGES, _pages
from .session import dealt


@query(f"""
WITH {_PAGES} SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://' || host || '/billing/' || page_id || '?page=' || page_id || '&limit=5'
    WHEN 1 THEN 'https://' || host || '/invoices/page/' || page_id WHEN 7 THEN 'https://' || host || '/receipts?cursor=x' || page_id END AS url
    FROM p""")
def continuation_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next pages of the pages' hosts: some to other hosts, with other keys, about something else, without a page, or with a hash."""
    id, host = F.col("page_id"), F.col("host")
    at = text("https://", host)
    url = by(
        id, text("/billing/", id, "?page=", id, "&limit=5"), text(at, "/invoices/page/", id), text("https://x.", host, "/billing?page=", id),
        text(at, "/billing?page=1&team=", id), text(at, "/songs?page=", id), text(at, "/billing/", id), text(at, "/billing?page=", id, "#x"),
        text(at, "/receipts?cursor=x", id),
    )
    return _pages(spark, sf_dir).select("page_id", guards.continuation_url(url, at).alias("url"))


@query(f"""
WITH {_PAGES} SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://' || host || '/pdf/' || page_id
    WHEN 1 THEN 'https://' || host || '/x?id=' || page_id WHEN 2 THEN 'https://' || host || '/y/' || page_id END AS url FROM p""")
def observed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of pages: by shape, by type, by intent; and a page, another origin, a POST, and an image of the right shape."""
    id, at = F.col("page_id"), text("https://", F.col("host"))
    url = by(
        id, text(at, "/pdf/", id, "#p"), text(at, "/x?id=", id), text(at, "/y/", id), text(at, "/z/", id),
        text("https://other.example.com/f.pdf?", id), text(at, "/pdf/", id), text(at, "/download/", id),
    )
    kind = by(
        id, text(""), text("application/PDF; x=1"), text("text/html"), text("text/html"), text("application/pdf"), text("application/pdf"),
        text("image/png"),
    )
    seen = guards.observed_document(
        url, by(id, *[text(m) for m in ("get", "GET", "GET", "GET", "GET", "POST", "GET")]), kind, F.lit(None).cast("string"), id % 7 == 2,
        F.array(at),
    )
    return _pages(spark, sf_dir).select("page_id", seen.alias("url"))


@query(
    "SELECT page_id, page_id % 4 = 0 AND url LIKE 'https:%' AS allowed, CASE page_id % 5 WHEN 1 THEN 'endpoint' WHEN 2 THEN 'header' WHEN 3 THEN 'token' END AS refusal FROM pages"
)
def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a recipe's hosts admit each page, and whether results may be sent to its host."""
    id, host = F.col("page_id"), F.col("host")
    hosts = F.array(
        text("https://z.", host, "/*"),
        by(id, text("https://", host, "/*"), text("https://*.", host, "/*"), text("https://", host), text("https://w.", host, "/*")),
    )
    endpoint = by(
        id, text("https://", host, "/in"), text("http://", host, "/in"), text("https://", host), text("https://", host),
        text("http://localhost:8080/", id),
    )
    headers = F.when(id % 5 == 2, F.array(F.lit("X-A"), F.lit("Content-Type"))).otherwise(F.array(F.lit("X-A")))
    token, known = F.when(id % 5 != 4, "t"), F.array(F.lit("a.example.com"), F.when(id % 5 == 3, "b.example.com").otherwise(text(" ", F.upper(host), " ")))
    return _pages(spark, sf_dir).select(
        "page_id", guards.is_allowed(F.col("url"), hosts).alias("allowed"), guards.sink_refusal(endpoint, headers, token, known).alias("refusal"),
    )


@query("""
WITH r AS (SELECT l_orderkey AS c, l_linenumber AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice) AS p, CASE WHEN l_partkey % 97 = 0 THEN 'null' ELSE 'i' || (l_partkey % 40) END AS id,
    CASE l_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN l_partkey % 5 = 0 THEN 'https://b.example.com/x' ELSE 'https://a.example.com/y' END
        ELSE 'https://a.example.com/' || l_partkey END AS url, l_partkey % 4 > 0 AS act FROM lineitem),
k AS (SELECT * FROM r WHERE s < 6),
f AS (SELECT c, id, min(p) AS p FROM k GROUP BY 1, 2),
j AS (SELECT c, p, CASE WHEN id = 'null' THEN 'invalid_identity' WHEN url IS NULL AND c % 2 = 0 AND NOT act THEN 'invalid_document_path'
    WHEN url LIKE 'https://b.%' THEN 'unapproved_document_origin' END AS code FROM f JOIN k USING (c, id, p)),
g AS (SELECT c, count(*) AS n, arg_min(code, p) FILTER (code IS NOT NULL) AS bad FROM j GROUP BY 1)
SELECT o_orderkey AS candidate, CASE WHEN bad IS NULL AND n IS NOT NULL THEN n END::INTEGER AS count, CASE WHEN n IS NULL THEN 'no_documents'
    ELSE bad END AS code FROM orders LEFT JOIN g ON c = o_orderkey""")
def candidate_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates with their lines as refs in scopes by line number, from 15 on beyond the scopes that count."""
    from pyspark.sql import Window

    part, key = F.col("l_partkey"), F.col("l_orderkey")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    url = F.when(F.col("l_suppkey") % 9 == 0, None).when(
        F.col("l_suppkey") % 9 == 1, F.when(part % 5 == 0, "https://b.example.com/x").otherwise("https://a.example.com/y"),
    ).otherwise(text("https://a.example.com/", part))
    refs = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        key.alias("candidate"), (
            F.col("l_linenumber") + F.when(F.col("l_linenumber") >= 6, 14).otherwise(0)
        ).alias("scope"), pos.alias("pos"), F.when(part % 97 == 0, "null").otherwise(text("i", part % 40)).alias("id"), url.alias("document_url"), (part % 4 > 0).alias("action")
    )
    candidates = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("candidate"), F.array(F.lit("https://a.example.com")).alias("origins"),
        (F.col("o_orderkey") % 2 == 1).alias("requests"),
    )
    return admission.previews(candidates, refs, "candidate")


@query("""
WITH e AS (SELECT user_id, event_id, event_id % 37 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type, value FROM events),
c AS (SELECT *, CASE WHEN k <> 0 THEN row_number() OVER (PARTITION BY user_id, k ORDER BY i) END AS again,
    sum(1 + event_id % 3) OVER (PARTITION BY user_id ORDER BY i) AS n FROM e),
d AS (SELECT *, CASE WHEN event_type = 'error' AND value > 50 THEN 'auth_expired' WHEN event_type = 'error' AND value > 30 THEN 'http_error'
    WHEN n > 50 THEN 'too_many_values' WHEN event_type = 'signup' AND value > 40 THEN 'done' WHEN k = 0 THEN 'continuation_failed'
    WHEN again > 1 THEN 'repeated_cursor' WHEN i >= 12 THEN 'page_cap' END AS cause FROM c),
f AS (SELECT user_id, min(i) FILTER (cause IS NOT NULL) AS i, max(i) AS last FROM d GROUP BY 1)
SELECT f.user_id, coalesce(f.i, f.last)::INTEGER AS pages, CASE WHEN d.cause IS NULL THEN 'missing_page'
    WHEN d.cause <> 'done' THEN d.cause END AS cause, CASE WHEN d.cause = 'done' THEN d.n END::INTEGER AS n_values FROM f LEFT
    JOIN d ON d.user_id = f.user_id AND d.i = f.i""")
def config_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as pages of an option: errors, ends, missing and repeated cursors, too many values, too many pages."""
    id, kind, value = F.col("event_id"), F.col("event_type"), F.col("value")
    status = F.when((kind == "error") & (value > 50), 401).when((kind == "error") & (value > 30), 500).otherwise(200)
    rows = table(spark, sf_dir, "events").select(
        "user_id", id.alias("page"), status.alias("status"), F.array_repeat(text("v", id), (1 + id % 3).cast("int")).alias("found"), (~((kind == "signup") & (value > 40))).alias("more"), F.when(id % 37 != 0, text("c", id % 37)).alias("following")
    )
    out = admission.config_values(rows, ["user_id"], "page", "status", "found", "more", "following", 12)
    return out.select("user_id", "pages", "cause", F.when(F.col("cause").isNull(), F.size("values")).alias("n_values"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey, 'https://' || lower(substr(o_orderpriority, 3)) || '.example.com' AS origin FROM orders),
    g AS (SELECT DISTINCT o_custkey, 'https://' || lower(substr(o_orderpriority, 3)) || '.example.com' AS origin FROM orders
    WHERE o_orderstatus = 'F')
SELECT o_custkey, list_sort(list(origin)) AS missing FROM o ANTI JOIN g USING (o_custkey, origin) GROUP BY 1""")
def missing_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins that a customer's orders need, less those of its finished ones."""
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", text("https://", F.lower(F.substr("o_orderpriority", F.lit(3))), ".example.com").alias("origin"),
    )
    return admission.missing_origins(rows, rows.where("o_orderstatus = 'F'"), ["o_custkey"], "origin")


@query("""
WITH s AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
n AS (SELECT c_nationkey, min(c_custkey) AS old FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT s.s_nationkey, coalesce('c' || old, 's' || s_suppkey) AS id, s_suppkey FROM s LEFT JOIN n ON c_nationkey = s_nationkey WHERE k <= 50
    AND s_suppkey % 7 > 0""")
def stored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's suppliers as profiles, 50 at most and some not valid, under the id of the nation's first customer of one segment."""
    rows = table(spark, sf_dir, "supplier").select(
        "s_nationkey", "s_suppkey", text("s", F.col("s_suppkey")).alias("id"),
        text("https://n", F.col("s_nationkey"), ".example.com").alias("origin"),
    )
    old = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").groupBy(
        text("https://n", F.col("c_nationkey"), ".example.com").alias("origin")
    ).agg(text("c", F.min("c_custkey")).alias("id"))
    kept = admission.stored_profiles(rows, "s_nationkey", "id", "s_suppkey", F.col("s_suppkey") % 7 > 0)
    return admission.reused_ids(kept, old, "origin", "id").select("s_nationkey", "id", "s_suppkey")


@query("""
SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 11 = 5 DESC,
    ['é', 'e', 'f', 'E', 'z'][n_nationkey % 5 + 1] || n_name COLLATE en, ['é', 'e', 'f', 'E', 'z'][n_nationkey % 5 + 1] || n_name)::INTEGER AS place
    FROM nation""")
def destination_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(by(F.col("n_nationkey"), *map(F.lit, "éefEz")), "n_name")
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", name.alias("name"))
    return admission.destinations_in_order(rows, "n_regionkey", F.col("n_nationkey") % 11 == 5, "name").select("n_regionkey", "n_nationkey", "place")


@query("""
WITH b AS (SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS last FROM supplier GROUP BY 1)
SELECT n_nationkey, 'c' || n_regionkey AS company, CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE 'c' || n_regionkey END AS name, coalesce(n,
    0)::BIGINT AS suppliers, last, n_nationkey % 5 = 1 AS reconnect
FROM nation LEFT JOIN b ON s_nationkey = n_nationkey WHERE n_nationkey % 5 > 0 AND n_nationkey % 7 > 0""")
def connected_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        "n_nationkey", by(id, *map(F.lit, ("filesystem", "unavailable", "company", "company", "company"))).alias("kind"),
        text("c", F.col("n_regionkey")).alias("company"), F.when(id % 3 > 0, F.col("n_name")).alias("name"), (id % 7 > 0).alias("held"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_acctbal").alias("last"))
    return admission.connected_companies(rows, suppliers, "n_nationkey")


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'),
    lambda w: upper(w[1]) || w[2:]), ' ') || '-' || p_size AS title, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th'
    WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS day,
  CASE WHEN p_partkey % 3 = 0 THEN p_size || CASE WHEN p_size = 1 THEN ' invoice' ELSE ' invoices' END
      ELSE (p_size - 1) || ' of ' || p_size END AS shown, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE 'Invoice' END AS label,
  replace(p_name, ' ', '-') || '-' || CASE WHEN p_size % 2 = 0 THEN 'unknown' ELSE p_type END || '-' || p_partkey || '.pdf' AS file,
      p_retailprice * 100 BETWEEN 40000 AND 100000 AS recent FROM part""")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, id = F.col("p_size"), F.col("p_partkey")
    kebab = F.replace("p_name", F.lit(" "), F.lit("-"))
    file = by(id, text("x.pdf"), text(F.col("p_name"), ".PDF"), text("a-unknown-", id, ".pdf"), text("document-", F.substring(F.md5(text(id)), 1, 12), ".pdf"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", labels.title_case(text(kebab, "-", size)).alias("title"), labels.ordinal_day(size).alias("day"), labels.count_label(
            F.when(id % 3 == 0, size).otherwise(size - 1), size,
        ).alias("shown"), labels.invoice_label(F.when(id % 4 == 0, F.col("p_brand")), file).alias("label"),
        labels.file_name(
            kebab, F.when(size % 2 == 1, F.col("p_type")), id.cast("string"),
        ).alias("file"), labels.is_recent(F.col("p_retailprice") * 100, F.lit(100_000)).alias("recent"),
    )


@query("""
WITH o AS (SELECT o_custkey, unnest(['https://' || lower(o_orderstatus) || '.example.com', CASE WHEN o_orderkey % 3 > 0 THEN 'https://p' || (o_orderkey % 4) || '.example.com' END, 'https://p' || (o_orderkey % 6) || '.example.com']) AS x FROM orders)
SELECT o_custkey, list_sort(list(DISTINCT x)) AS origins FROM o WHERE x IS NOT NULL GROUP BY 1""")
def united_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    own, others = text("https://", F.lower("o_orderstatus"), ".example.com"), F.array(F.when(key % 3 > 0, text("https://p", key % 4, ".example.com")), text("https://p", key % 6, ".example.com"))
    return admission.united_origins(table(spark, sf_dir, "orders").select("o_custkey", own.alias("own"), others.alias("others")), ["o_custkey"], ["own", "others"])


@query("""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_filter(list_concat(w, ['red', 'bolt', 'red']), lambda x, i: NOT list_contains(['bolt', 'ring'], x) AND list_position(list_concat(w, ['red', 'bolt', 'red']), x) = i), ',') AS left_out, array_to_string(list_filter(w, lambda x, i: list_contains(['red', 'blue', 'ring', 'bolt'], x) AND list_position(w, x) = i), ',') AS kept FROM p""")
def origin_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts' names as what was attempted, less what is enabled, and as what is asked for, where it is allowed."""
    words = F.split("p_name", " ")
    attempted = F.concat(words, F.array(*map(F.lit, ("red", "bolt", "red"))))
    left = admission.not_enabled(attempted, F.array(F.lit("bolt"), F.lit("ring")))
    kept = admission.allowed_only(words, ("red", "blue", "ring", "bolt"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(left, ",").alias("left_out"), F.array_join(kept, ",").alias("kept"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS batch, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 AS slot FROM orders")
def fetch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return admission.batches(rows, ["o_custkey"], [F.asc("o_orderkey")]).select("o_orderkey", "batch", "slot")


@query("""
WITH l AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1 HAVING max(o_orderkey) % 4 > 0),
a AS (SELECT o_custkey, min(o_orderkey) AS source FROM orders JOIN l USING (o_custkey) WHERE o_orderkey < last AND o_orderkey % 5 IN (1, 3) GROUP BY 1)
SELECT o_custkey AS session, source, CASE source % 5 WHEN 1 THEN 'data.accessToken' ELSE 'token' END AS path FROM a""")
def token_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as answers, the last as a listing with a bearer token: two kinds give one, one is no account's address, one has no token, one nothing at all."""
    key = F.col("o_orderkey")
    url = by(key, text("https://e.com/list"), text("https://e.com/session"), text("https://e.com/api/token"), text("https://e.com/users/me?x=1"), text("https://e.com/account/", key))
    gone = by(key, F.array().cast("array<string>"), F.array(F.lit("user.email"), F.lit("data.accessToken"), F.lit("token")), F.array(F.lit("token")), F.array(F.lit("token")), F.array(F.lit("data.tokens")))
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), key.alias("pos"), url.alias("url"), gone.alias("gone"))
    last = entries.groupBy("session").agg(F.max("pos").alias("pos"))
    return admission.token_sources(entries, last.withColumn("scheme", F.when(F.col("pos") % 4 > 0, "bearer").otherwise("basic")))


@query("""
SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'id' WHEN 2 THEN CASE WHEN p_size > 10 THEN 'invoices.list.paginate' ELSE '' END WHEN 3 THEN 'auth.check.expect' WHEN 4 THEN '(root)' WHEN 5 THEN 'invoices.list.map.total' WHEN 6 THEN 'invoices.strategy' WHEN 7 THEN 'hosts,name' WHEN 8 THEN 'invoices.list.map.id' WHEN 9 THEN '(root)' ELSE '' END AS faults FROM part""")
def recipe_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe documents named and sized after parts: right ones, and nine kinds that depart from the schema, one only where a number is too large."""
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 10
    request = '{"url":"https://e.com/api"}'
    document = text(
        '{"id":"', F.when(kind == 1, F.col("p_brand")).otherwise(text("p-", key)), '","name":"', F.when(kind == 7, "").otherwise(F.col("p_name")), '","homepage":"https://e.com","hosts":[', F.when(kind == 7, "").otherwise('"https://e.com/*"'), '],"auth":{"check":{"request":', request,
        ',"expect":{"', F.when(kind == 3, "status").otherwise("statusIn"), '":[', size, ']}},"loginUrl":"https://e.com/login"},"invoices":{"strategy":"', F.when(kind == 6, F.lower("p_type")).otherwise("network"), '","list":{"request":', request, ',"items":"$","map":{"', F.when(kind == 8, "ref").otherwise("id"),
        '":"id","total":{"path":"t","transforms":[{"kind":"divide","by":', F.when(kind == 5, -size).otherwise(size), '}]}},"paginate":{"kind":"page","maxPages":', F.when(kind == 2, size * 10).otherwise(size), '}},"document":{}}', F.when(kind == 4, text(',"', F.col("p_name"), '":1')).otherwise(""), F.when(kind == 9, "").otherwise("}"),
    )
    # a part named `ref` is a member too many, and the id is missing
    found = F.filter(schema.faults_column(document), lambda p: p != "invoices.list.map")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("faults"))
