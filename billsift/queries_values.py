"""Registered queries of rules on single values, fed from the tables' own values, with the rules written in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import controls, exploration, policy, transforms, urls, values
from .operators import actions
from .plans import recipe
from .queries import query, table
from .queries_tracing import by, text
from .sources import scans

#: Pages with their host, and their address without query and hash.
_PAGES = "p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_replace(url, '[?#].*$', '') AS bare FROM pages)"


def _host() -> Column:
    return F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", _host().alias("host"), F.regexp_replace("url", "[?#].*$", "").alias("bare"), "html")


@query(f"""
WITH {_PAGES}, h AS (SELECT page_id, [host, 'billing.' || host, 'app.' || page_id || '_x.co', 'portal', replace(host, '.example', '.io')][page_id % 5 + 1] AS h FROM p),
l AS (SELECT *, list_filter(string_split(h, '.'), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in urls.SERVICE_LABELS)})) AS labels FROM h),
n AS (SELECT *, coalesce(nullif(list_filter(labels, lambda w, i: i = 1 OR w NOT IN ({', '.join(f"'{w}'" for w in urls.SUFFIX_LABELS)}))[-1], ''), h) AS label FROM l)
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'vendor') AS vendor FROM n""")
def vendor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, id = F.col("host"), F.col("page_id")
    named = by(id, host, text("billing.", host), text("app.", id, "_x.co"), text("portal"), F.replace(host, F.lit(".example"), F.lit(".io")))
    return _pages(spark, sf_dir).select("page_id", urls.vendor_id(named).alias("vendor"))


@query("""
WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS kind, (o_orderdate + INTERVAL 3650 DAY)::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN year(d) BETWEEN 2000 AND 2100 AND (kind NOT IN (1, 2) OR day(d) > 12) THEN strftime(d, '%Y-%m-%d') END AS day FROM d""")
def displayed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as pages show them: one form of each order; day and month can't be told apart up to the 12th."""
    day = F.date_add(F.col("o_orderdate").cast("date"), 3650)
    shown = by(
        F.col("o_orderkey"),
        *[F.date_format(day, f) for f in ("yyyy-MM-dd", "d.M.yyyy", "M/d/yyyy", "MMMM d, yyyy", "d MMM yyyy", "'due 'yyyy/M/d' now'")],
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", values.displayed_date(shown).alias("day"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 5 AS kind, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
w AS (SELECT *, cents // 100 AS whole, lpad((cents % 100)::VARCHAR, 2, '0') AS rest FROM c)
SELECT o_orderkey, CASE WHEN kind IN (0, 1) THEN whole || '.' || rest WHEN kind = 2 THEN whole || '.' || left(rest, 1) WHEN kind = 3 AND (whole < 1000 OR whole >= 1000000) THEN whole::VARCHAR END AS amount,
  CASE kind WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS currency FROM w""")
def displayed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of orders as pages show them; one separator before three digits leaves an amount open."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    shown = by(
        F.col("o_orderkey"), text("$", F.format_number(whole, 0), ".", rest),
        text(F.translate(F.format_number(whole, 0), ",", "."), ",", rest, " EUR"), text("£", whole, ".", F.left(rest, F.lit(1))),
        F.format_number(whole, 0), text("about ", whole),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", values.displayed_amount(shown).alias("amount"), values.currency_of(shown).alias("currency"))


@query(
    """SELECT event_id, least(greatest(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN user_id WHEN 2 THEN epoch(date_trunc('second', ts))::BIGINT - 1705276800 ELSE 30 END, 0), 86400)::BIGINT AS wait FROM events"""
)
def retry_after_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with seconds, times of events, and words, read at noon of the month's middle."""
    header = by(
        F.col("event_id"), text(F.col("event_id")), text(" ", F.col("user_id"), " "), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        F.col("event_type"),
    )
    return table(spark, sf_dir, "events").select("event_id", values.retry_after(header, F.lit(1705276800).cast("long")).alias("wait"))


@query(f"""
WITH {_PAGES}, d AS (SELECT page_id, page_id % 6 AS kind, 'https://' || host AS o, page_id::VARCHAR AS i FROM p),
u AS (SELECT *, o || [ '/d/inv_' || i || '.pdf?x-amz-date=' || i || '&b=2&a=' || i || '#top', '/download?token=t&id=' || i, '/download?token=' || i, '/i/acct_' || i || '/inv_' || i || '?s=db', '/file?Expires=1&Signature=' || i, '/x/INV-' || i || '/pdf'][kind + 1] AS url FROM d)
SELECT page_id, CASE kind WHEN 0 THEN o || '/d/inv_' || i || '?a=' || i || '&b=2' WHEN 1 THEN o || '/download?id=' || i ELSE url END AS canonical, CASE kind WHEN 3 THEN o || '/invoice/acct_' || i || '/inv_' || i || '/pdf' ELSE url END AS hosted,
  [3, 1, 1, 0, 0, 2][kind + 1] AS stable, CASE WHEN kind IN (0, 3) THEN 'inv_' || i ELSE 'document' END || '-' || substr(sha256(url), 1, 24) AS id FROM u""")
def document_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the pages' hosts, with volatile and lasting query keys."""
    i = F.col("page_id")
    path = by(
        i, text("/d/inv_", i, ".pdf?x-amz-date=", i, "&b=2&a=", i, "#top"), text("/download?token=t&id=", i), text("/download?token=", i),
        text("/i/acct_", i, "/inv_", i, "?s=db"), text("/file?Expires=1&Signature=", i), text("/x/INV-", i, "/pdf"),
    )
    docs = _pages(spark, sf_dir).select("page_id", text("https://", F.col("host"), path).alias("u"))
    url = F.col("u")
    return docs.select(
        "page_id", urls.canonical_document_url(url).alias("canonical"), urls.provider_document(url).alias("hosted"),
        urls.stability_score(url).cast("int").alias("stable"), policy.id_from_href(url).alias("id"),
    )


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url || 'n' WHEN 2 THEN url END AS target FROM pages")
def next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    header = by(
        F.col("page_id"), text("<", url, '>; rel="next"'), text("<", url, '>; rel="prev", <', url, 'n>; rel="last next"'),
        text("<", url, ">; rel=next; title=x"), text("<", url, '>; rel="nextish"'), text(""),
        text("<", url, '>;rel="first"', F.repeat(F.lit(" "), F.lit(5000))),
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.next_in_link_header(header).alias("target"))


@query(f"""
WITH {_PAGES} SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://' || host || '/list?page=' || page_id WHEN 1 THEN CASE WHEN url LIKE 'https:%' THEN regexp_replace(url, '#.*$', '') END WHEN 2 THEN 'https://' || host || '/v1/items?cursor=' || page_id WHEN 3 THEN 'https://' || host || '/v1/next/' || page_id END AS url FROM p""")
def same_origin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, host = F.col("page_id"), F.col("host")
    link = by(
        id, text("/list?page=", id), F.col("url"), text("?cursor=", id, "#x"), text("next/", id), text("//other.example.com/", id),
        text("https://me@", host, "/a"),
    )
    return _pages(spark, sf_dir).select("page_id", recipe.same_origin(link, text("https://", host, "/v1/items?limit=5")).alias("url"))


@query("""
WITH f AS (SELECT event_id, [(user_id % 3)::VARCHAR, upper((event_type = 'click')::VARCHAR), ' ' || CASE WHEN user_id % 2 = 0 THEN 'no' ELSE 'Off' END || ' ', event_type, ''][event_id % 5 + 1] AS f FROM events)
SELECT event_id, lower(trim(f)) NOT IN ('', 'false', 'no', '0', 'null', 'off') AS more FROM f""")
def continuation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = by(
        F.col("event_id"), text(F.col("user_id") % 3), F.upper((F.col("event_type") == "click").cast("string")),
        text(" ", F.when(F.col("user_id") % 2 == 0, "no").otherwise("Off"), " "), F.col("event_type"), text(""),
    )
    return table(spark, sf_dir, "events").select("event_id", transforms.truthy(flag).alias("more"))


@query("SELECT p_partkey, p_name || '/' || p_brand || '-' || p_type || '/' || p_size || '/x/7/8' AS folder FROM part")
def save_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = text(" ", F.replace("p_name", F.lit(" "), F.lit("\t ")), " / .. /", F.col("p_brand"), ":", F.col("p_type"), "\\", F.col("p_size"), "//.x/7/8/9")
    return table(spark, sf_dir, "part").select("p_partkey", policy.folder_path(root).alias("folder"))


@query("SELECT p_partkey, ['other', 'text', 'image', 'json', 'pdf', 'html', 'missing', 'binary'][p_partkey % 8 + 1] AS class FROM part")
def content_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, name = F.lower("p_type"), F.col("p_name")
    told = by(
        F.col("p_partkey"), text("application/", kind), text(" TEXT/", kind, "; charset=", name), text("image/", F.col("p_brand")),
        text("application/", kind, "+JSON"), text("Application/PDF ;", name), text("text/html;", name), text(" ;", name),
        text("application/octet-stream;", name),
    )
    return table(spark, sf_dir, "part").select("p_partkey", policy.content_class(told).alias("class"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract(text, '\\p{L}+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN w = '' AND doc_id % 4 IN (1, 2) THEN CASE doc_id % 4 WHEN 1 THEN '.pdf' END ELSE CASE doc_id % 4 WHEN 0 THEN w || ' +.pdf' WHEN 1 THEN w || '.pdf' WHEN 2 THEN w END END AS name FROM w""")
def disposition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of the first words of documents, which have accents: encoded, quoted with a folder, bare, or none."""
    word = F.regexp_extract("text", r"\p{L}+", 0)
    header = by(
        F.col("doc_id"), text("attachment; filename*=UTF-8''", F.url_encode(word), "%20+.pdf; filename=c.pdf"),
        text('attachment; filename="x/', word, '.pdf"'), text("inline; filename=a\\", word, " "), text("attachment; name=", word),
    )
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", policy.disposition_filename(header).alias("name"))


@query(f"""
WITH n AS (SELECT p_partkey, [lower(p_type) || 'Token', p_name, p_brand || '-api-key', 'Team' || CASE WHEN p_size % 2 = 0 THEN ' Id' ELSE 'Ids' END, p_type || ' session ' || p_size, 'secret' || p_size, 'customers_id'][p_partkey % 7 + 1] AS n FROM part),
k AS (SELECT *, lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[-\\s]+', '_', 'g')) AS key FROM n)
SELECT p_partkey, key, regexp_matches(key, '{policy.SECRET_KEY}') OR regexp_matches(key, '{policy.SECRET_NAME}') AS secret, regexp_matches(key, '{policy.TENANT_NAME}') AS tenant FROM k""")
def policy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    name = by(
        F.col("p_partkey"), text(F.lower("p_type"), "Token"), F.col("p_name"), text(F.col("p_brand"), "-api-key"),
        text("Team", F.when(size % 2 == 0, " Id").otherwise("Ids")), text(F.col("p_type"), " session ", size), text("secret", size),
        text("customers_id"),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", policy.policy_key(name).alias("key"), policy.is_secret_name(name).alias("secret"), policy.is_tenant_name(name).alias("tenant"),
    )


@query("""
WITH v AS (SELECT c_custkey, ['page', 'access_token', 'team_id', 'q', 'range', 'op'][c_custkey % 6 + 1] AS k, [c_custkey::VARCHAR, c_name, (9999500 + c_custkey)::VARCHAR, replace(c_name, '#', ' '), '{' || lower(c_mktsegment) || '}', replace(c_name, '#', '-')][c_custkey % 6 + 1] AS v FROM customer)
SELECT c_custkey, k <> 'access_token' AND (contains(v, '{') OR (k = 'team_id' AND len(v) BETWEEN 7 AND 20) OR regexp_full_match(v, '[A-Za-z0-9_.:+-]{1,64}')) AS kept FROM v""")
def query_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    keys = by(key, *map(F.lit, ("page", "access_token", "team_id", "q", "range", "op")))
    given = by(
        key, text(key), name, text(9_999_500 + key), F.replace(name, F.lit("#"), F.lit(" ")), text("{", F.lower("c_mktsegment"), "}"),
        F.replace(name, F.lit("#"), F.lit("-")),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", policy.is_query_value(keys, given).alias("kept"))


@query("SELECT page_id, page_id % 6 IN (0, 5) AS exact FROM pages")
def origin_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, host = F.col("page_id"), F.col("host")
    told = by(
        id, text("https://", host, "/*"), text("http://", host, "/*"), text("https://", host), text("https://*.", host, "/*"),
        text("https://10.", id % 256, ".0.1/*"), text("https://8.8.", id % 256, ".8:443/*"),
    )
    return _pages(spark, sf_dir).select("page_id", policy.is_origin_pattern(told).alias("exact"))


@query(
    "SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'session_expired' WHEN 2 THEN 'session_expired' WHEN 3 THEN 'blocked_or_challenged' WHEN 4 THEN 'blocked_or_challenged' END AS outcome FROM pages"
)
def redirect_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each page's address to itself, to its host's login, to another page of it, to nothing, and to itself with a slash and a hash."""
    id, host = F.col("page_id"), F.col("host")
    bare = F.regexp_replace("bare", "/$", "")
    final = by(id, bare, text("https://", host, "/x/login?next=", id), text("https://sso.", host, "/y"), text(bare, "x"), text(""), text(bare, "/#top"))
    return _pages(spark, sf_dir).select("page_id", policy.redirect_outcome(final, bare).alias("outcome"))


@query("""
WITH s AS (SELECT event_id, 190 + event_id % 330 AS s, event_type = 'click' AS d FROM events)
SELECT event_id, CASE WHEN s = 409 AND d THEN 'deduped' WHEN s IN (401, 403) THEN 'unauthorized' WHEN s < 200 OR s > 299 THEN 'failed' WHEN d THEN 'deduped' ELSE 'accepted' END AS outcome FROM s""")
def sink_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", policy.sink_outcome((190 + F.col("event_id") % 330).cast("int"), F.col("event_type") == "click").alias("outcome"),
    )


@query("""
WITH h AS (SELECT event_id, event_type, ['Authorization', 'Cookie', 'X-' || event_type, event_type, 'My-' || event_type || '-Key', 'Bad ' || event_type, 'proxy-authorization'][event_id % 7 + 1] AS n, ['Bearer ', 'basic ', 'Bearer'][user_id % 3 + 1] || user_id AS v FROM events)
SELECT event_id, CASE WHEN contains(n, ' ') OR lower(n) = event_type THEN NULL WHEN contains(lower(n), 'authorization') AND v LIKE 'Bearer %' THEN 'bearer' WHEN contains(lower(n), 'authorization') AND v LIKE 'basic %' THEN 'basic' ELSE 'custom' END AS scheme FROM h""")
def header_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = by(
        F.col("event_id"), text("Authorization"), text("Cookie"), text("X-", kind), kind, text("My-", kind, "-Key"), text("Bad ", kind),
        text("proxy-authorization"),
    )
    value = text(by(F.col("user_id"), text("Bearer "), text("basic "), text("Bearer")), F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", policy.header_marker(name, value).alias("scheme"))


@query(f"""
WITH n AS (SELECT doc_id, trim(regexp_replace(trim(substr(text, 1, (450 + doc_id % 100)::INT) || CASE doc_id % 5 WHEN 1 THEN ' id ' || (doc_id * 1000) WHEN 2 THEN ' the  Token' ELSE '' END), '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, len(t) > 500 OR regexp_matches(t, '{exploration.NOTE_REFUSED}') AS refused FROM n)
SELECT doc_id, CASE WHEN NOT refused THEN nullif(t, '') END AS note, refused AND t <> '' AS refused FROM r""")
def feedback_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of documents as notes, some too long, some with addresses, numbers or a secret's name."""
    id = F.col("doc_id")
    note = F.concat(
        F.substring("text", F.lit(1), (450 + id % 100).cast("int")),
        F.when(id % 5 == 1, text(" id ", id * 1000)).when(id % 5 == 2, F.lit(" the  Token")).otherwise(""),
    )
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", exploration.feedback_note(note).alias("n")).select("doc_id", "n.*")


@query("""
SELECT c_custkey, ['node.', 'attributes.', '', 'node.', ''][c_custkey % 5 + 1] AS prefix, CASE WHEN c_custkey % 5 < 3 THEN c_custkey::VARCHAR END AS id FROM customer""")
def list_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    item = F.try_parse_json(
        by(
            key, text('{"node":{"id":', key, "}}"), text('{"attributes":{"id":', key, '},"node":null}'), text('{"id":', key, ',"node":"', name, '"}'),
            text('{"node":["', name, '"],"attributes":{}}'), text("[", key, "]"),
        )
    )
    prefix = exploration.envelope(item)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", prefix.alias("prefix"), F.try_variant_get(exploration.unwrapped(item, prefix), "$.id", "string").alias("id"),
    )


@query("""
SELECT event_id, user_id % 4 > 0 AND event_type IN ('view', 'click', 'error') AND event_id * 3600 BETWEEN 0 AND 3600000 AND event_id % 7 <> 3 AND event_id % 11 <> 5 AND event_id % 13 <> 2 AS readable FROM events""")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of runs: some with a trigger or status that is none, too long a time, a count that is not whole, a missing one, or no JSON."""
    id = F.col("event_id")
    trigger = by(F.col("user_id"), text("never"), *map(F.lit, exploration.TRIGGERS))
    status = F.coalesce(
        *[F.when(F.col("event_type") == k, F.lit(s)) for k, s in (("view", "ok"), ("click", "partial"), ("error", "error"))], F.col("event_type"),
    )
    counts = text(
        '"counts":{"accepted":', F.when(id % 7 == 3, F.lit("1.5")).otherwise(text(id % 100_000)),
        ',"verified":1,"documentActions":0,"pageOwnedDownloads":0,"failedScopes":0', F.when(id % 11 == 5, "").otherwise(',"emptyScopes":2'), "}",
    )
    record = text('{"trigger":"', trigger, '","status":"', status, '","elapsedMs":', id * 3600, ",", counts, F.when(id % 13 == 2, "").otherwise("}"))
    return table(spark, sf_dir, "events").select("event_id", exploration.is_run_record(record).alias("readable"))


@query(f"""
WITH {_PAGES} SELECT page_id, CASE page_id % 5 WHEN 0 THEN bare || '?year=' || page_id || '&api_key=REDACTED' WHEN 1 THEN bare || '?x=REDACTED&y=' || page_id WHEN 2 THEN regexp_replace(url, '#.*$', '') WHEN 3 THEN bare || '/REDACTED/' || page_id ELSE bare || '?mytoken=' || page_id || '&session-id=REDACTED' END AS url, page_id % 5 <> 2 AS unbound FROM p""")
def replayable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, bare = F.col("page_id"), F.col("bare")
    given = by(
        id, text(F.regexp_replace(bare, "://", "://me:pw@"), "?year=", id, "&api_key=", id, "#top"), text(bare, "?x=Bearer%20abcdefgh12&y=", id),
        F.col("url"), text(bare, "/REDACTED/", id), text(bare, "?mytoken=", id, "&session-id=", id),
    )
    kept = exploration.replayable_url(given)
    return _pages(spark, sf_dir).select("page_id", kept.alias("url"), exploration.unbound_redaction(kept).alias("unbound"))


@query("SELECT page_id, page_id % 6 IN (0, 4) AS safe FROM pages")
def template_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, bare = F.col("page_id"), F.regexp_replace("bare", "/$", "")
    told = by(
        id, text(bare, "/teams/{teamId}/billing"), text(bare, "/download/{token}"), text(bare, "/{id}/", id), text(bare, "/teams/a{id}"), bare,
        text(bare, "/orgs/{org}/secret"),
    )
    return _pages(spark, sf_dir).select("page_id", exploration.is_safe_template_path(told).alias("safe"))


_LINKS = """
WITH l AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS o, unnest(regexp_extract_all(html, '(?i)\\bhref="([^"]+)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '(?i)\\bhref="([^"]+)"', 1), 1) - 1 AS pos FROM pages),
u AS (SELECT page_id, pos, o || h AS base, o || h || ['.pdf?token=' || page_id, '#x', ''][pos % 3 + 1] AS url, list_filter(string_split(h, '/'), lambda s: s <> '')[-1] AS seg, pos % 3 = 0 AS pdf, h FROM l),
c AS (SELECT *, coalesce(len(seg) > 3 AND NOT regexp_full_match(lower(seg), 'download|document|file|invoice|pdf|receipt|view'), false) AS named, CASE WHEN pdf AND NOT coalesce(len(seg) > 3 AND NOT regexp_full_match(lower(seg), 'download|document|file|invoice|pdf|receipt|view'), false) THEN base || '?token=' || page_id ELSE base END AS document FROM u)
"""


@query(f"""{_LINKS},
g AS (SELECT page_id, document, any_value(seg) AS seg, bool_or(named) AS named, arg_min(url, (CASE WHEN pdf THEN 0 ELSE 1 END, pos)) AS url, min(pos) AS pos, count(*) FILTER (pos % 4 <> 3) AS n FROM c GROUP BY 1, 2),
i AS (SELECT *, CASE WHEN named THEN seg ELSE 'document' END || '-' || substr(sha256(document), 1, 24) AS id, CASE WHEN named THEN seg ELSE 'document-' || substr(sha256(document), 1, 24) END AS old FROM g),
s AS (SELECT *, count(*) OVER (PARTITION BY page_id, old) AS shared FROM i)
SELECT page_id, document, url, id, CASE WHEN old <> id AND shared = 1 THEN old END AS alias, pos::INTEGER AS pos, least(n, 32)::INTEGER AS n_evidence FROM s""")
def document_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages as documents, each third as a PDF with a token and each third with a hash, and the evidence about three in four of them."""
    pages = table(spark, sf_dir, "pages").select("page_id", text("https://", _host()).alias("o"), F.posexplode(scans.anchors(F.col("html"))).alias("pos", "h"))
    links = pages.select("page_id", "pos", F.concat("o", "h", by(F.col("pos"), text(".pdf?token=", F.col("page_id")), text("#x"), text(""))).alias("href"))
    refs = actions.link_refs(links, ["page_id"], "href", "pos")
    told = links.where("pos % 4 <> 3").select("page_id", urls.canonical_document_url(F.col("href")).alias("document"), "pos")
    evidence = actions.merged_evidence(told, ["page_id", "document"], F.struct("pos"), "pos")
    both = actions.with_evidence(refs, evidence, ["page_id", "document"])
    return both.select("page_id", "document", "url", "id", "alias", "pos", F.size("evidence").alias("n_evidence"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderkey::VARCHAR AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey % 40 AS day, round(o_totalprice * 100)::BIGINT AS cents, left(o_orderpriority, 3) AS code, o_orderpriority AS p FROM orders),
v AS (SELECT *, CASE kind WHEN 0 THEN 'a ' || k WHEN 1 THEN d || 'T10:00' WHEN 2 THEN '2024-02-' || lpad(day::VARCHAR, 2, '0') WHEN 3 THEN (cents // 100000) || ' ' || lpad((cents // 100 % 1000)::VARCHAR, 3, '0') || ',' || lpad((cents % 100)::VARCHAR, 2, '0') WHEN 4 THEN code ELSE p || '/b\\' || k END AS v FROM c)
SELECT o_orderkey, v AS number, CASE WHEN kind = 1 THEN d WHEN kind = 2 AND day BETWEEN 1 AND 29 THEN v END AS day, CASE WHEN kind = 3 THEN (cents // 100000) || lpad((cents // 100 % 1000)::VARCHAR, 3, '0') || '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS total,
  CASE WHEN kind = 4 AND regexp_full_match(code, '[A-Za-z]{3}') THEN upper(code) END AS currency, replace(replace(v, '/', '_'), '\\', '_') AS filename FROM v""")
def claim_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's values as claims of every field: texts, days that may not be, totals with a blank, and codes."""
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    c = by(
        key, text("  a\n ", key, " "), F.date_format("o_orderdate", "yyyy-MM-dd'T10:00'"), text("2024-02-", pad(key % 40, 2)), text(
            F.floor(cents / 100_000), "  ", pad(F.floor(cents / 100) % 1000, 3), ",", pad(cents % 100, 2),
        ),
        F.left("o_orderpriority", F.lit(3)), text(F.col("o_orderpriority"), "/b\\", key),
    )
    names = {"number": "invoiceNumber", "day": "issuedAt", "total": "total", "currency": "currency", "filename": "filename"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[policy.normalised(f, c).alias(n) for n, f in names.items()])


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS kind, event_type AS t, user_id % 2 = 0 AS even FROM events)
SELECT event_id, CASE WHEN kind = 0 THEN 'bearer' WHEN kind = 1 THEN CASE WHEN even THEN 'basic' ELSE 'custom' END WHEN kind = 2 THEN 'custom' WHEN kind = 3 AND even THEN 'custom' ELSE 'none' END AS scheme,
  CASE WHEN kind IN (0, 1) THEN 'authorization' WHEN kind = 2 THEN 'cookie' WHEN kind = 3 AND even THEN 'x-' || t END AS header, CASE WHEN kind = 4 THEN 'application/' || t || '+json' END AS kept FROM e""")
def request_auths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made of events' kinds and users: schemes after custom ones, cookies, own headers, content types."""
    id, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id")
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    of = lambda *pairs: F.array(*[pair(n if isinstance(n, Column) else F.lit(n), v if isinstance(v, Column) else F.lit(v)) for n, v in pairs])
    even = user % 2 == 0
    headers = F.get(F.array(
        of(("X-App", kind), ("Authorization", text("Bearer ", user))), of(
            ("Accept", kind), ("authorization", F.when(even, text("Basic ", user)).otherwise(text("Digest ", user))),
        ), of(("Accept", "*/*"), ("Cookie", text("a=", user))),
        of(
            (F.when(even, text("X-", kind)).otherwise(kind), user.cast("string")), ("Content-Type", "nonsense"),
        ), of(("Content-Type", text("Application/", kind, "+JSON; charset=utf-8"))), of(("Bad Name", text("Bearer ", user))),
    ), (id % 6).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", exploration.request_auth(headers).alias("a"), exploration.kept_headers(headers).alias("kept"),
    ).select("event_id", "a.*", "kept")


def _re(pattern: str) -> str:
    """A fixed pattern in DuckDB's dialect, as a literal."""
    return "'" + pattern.replace("(?iu)", "(?i)").replace("'", "''") + "'"


@query(f"""
WITH c AS (SELECT p_partkey, p_partkey % 5 > 0 AS usable, ['Download ' || p_name, 'Get  invoice ' || p_size, 'file-text', 'Delete invoice download', p_name, 'Ladda ner faktura ' || p_brand, 'Save help ' || p_size][p_partkey % 7 + 1] AS m,
    CASE WHEN p_size % 2 = 0 THEN 'No ' || p_size || ' 2024-01-02' ELSE p_name END AS r, CASE WHEN p_size % 3 > 0 THEN 'Actions' ELSE p_type END AS k, CASE WHEN p_size % 5 < 2 THEN 'Billing history ' || p_brand ELSE p_brand END AS t, CASE WHEN p_size % 7 < 2 THEN 'Past invoices' ELSE p_type END AS g FROM part),
b AS (SELECT *, regexp_replace(m, '\\s+', ' ', 'g') AS mat FROM c)
SELECT p_partkey, CASE WHEN NOT usable OR regexp_matches(mat, {_re(controls.UNSAFE_LABEL)}) OR regexp_matches(mat, {_re(controls.UNRELATED)}) THEN NULL
  WHEN regexp_matches(mat, {_re(controls.EXPLICIT_ACTION)}) AND regexp_matches(mat, {_re(controls.DOCUMENT_CONTEXT)}) THEN 'explicit_document_label'
  WHEN regexp_matches(mat, {_re(controls.EXPLICIT_ACTION)}) AND regexp_matches(r || ' ' || t || ' ' || g, {_re(controls.DOCUMENT_CONTEXT)}) THEN 'invoice_context_action'
  WHEN regexp_matches(mat, {_re(controls.DOCUMENT_ICON)}) AND regexp_matches(k, {_re(controls.ACTION_COLUMN)}) AND (regexp_matches(r, {_re(controls.INVOICE_ROW)}) OR regexp_matches(t, {_re(controls.INVOICE_CONTEXT)})) AND regexp_matches(t || ' ' || g, {_re(controls.INVOICE_CONTEXT)}) THEN 'invoice_table_action' END AS basis FROM b""")
def control_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as controls: labels, icons and their rows, columns, tables and pages, with and without a word about invoices."""
    size, name, brand = F.col("p_size"), F.col("p_name"), F.col("p_brand")
    material = by(
        F.col("p_partkey"), text("Download ", name), text("Get  invoice ", size), text("file-text"), text("Delete invoice download"), name,
        text("Ladda ner faktura ", brand), text("Save help ", size),
    )
    row, column = F.when(size % 2 == 0, text("No ", size, " 2024-01-02")).otherwise(name), F.when(size % 3 > 0, "Actions").otherwise(F.col("p_type"))
    shown, page = F.when(size % 5 < 2, text("Billing history ", brand)).otherwise(brand), F.when(size % 7 < 2, "Past invoices").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", controls.control_basis(material, row, column, shown, page, F.col("p_partkey") % 5 > 0).alias("basis"),
    )


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract(trim(text), '^[^\\s,]+') AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, trim([w || ', open  account menu', 'Receipt history', w, 'Delete account', 'Past  Invoices', w || ' invoices', 'Historique des factures', 'Account ' || w][doc_id % 8 + 1]) AS l FROM w),
b AS (SELECT doc_id, substr(regexp_replace(l, '\\s+', ' ', 'g'), 1, 120) AS l FROM l)
SELECT doc_id, regexp_matches(l, {_re(controls.INVOICE_SECTION)}) AS section, NOT regexp_matches(l, {_re(controls.UNSAFE_LABEL)}) AND regexp_matches(l, {_re(controls.NAVIGATION)}) AS navigation, doc_id % 2 = 0 AND doc_id % 3 > 0 AS opens FROM b""")
def navigation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of documents as people's names and as labels, beside labels of sections and menus."""
    id, word = F.col("doc_id"), F.regexp_extract(F.trim("text"), r"^[^\s,]+", 0)
    label = by(
        id, text(word, ", open  account menu"), text("Receipt history"), word, text("Delete account"), text("Past  Invoices"),
        text(word, " invoices"), text("Historique des factures"), text("Account ", word),
    )
    opens = controls.is_menu_trigger(id % 2 == 0, F.lit(True), F.lit(True), id % 3 == 0)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", controls.is_invoice_section(label).alias("section"), controls.is_navigation_label(label).alias("navigation"), opens.alias("opens"),
    )
