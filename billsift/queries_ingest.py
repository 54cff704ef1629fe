"""Registered queries of evidence held within bounds, document bytes, and locale order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import content
from .operators import identity, ranking
from .queries import query, table
from .queries_tracing import text
from .sources import ingest, scans


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, url LIKE 'https:%' AS secure, html,
    list_filter(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"[^>]*>', 1), lambda x: true) AS hrefs FROM pages WHERE html IS NOT NULL),
r AS (SELECT page_id, count(*) FILTER (NOT fit) AS resources, count(*) FILTER (fit AND NOT within) AS bodies, count(*) FILTER (fit AND within) AS kept FROM (
  SELECT page_id, i <= 5 AND i % 4 <> 3 AND i * len(html) <= 256000 AS fit, i * len(html) <= 256000 AS within FROM p, range(1, 7) t(i)) GROUP BY 1),
u AS (SELECT page_id, count(*) FILTER (regexp_matches(lower(h), 'logout|log-out|signout|sign-out|delete|remove|cancel|checkout|purchase|upgrade|downgrade|authorize|oauth|callback|invite|payment[-_/]?method|\\.pdf$|(?:^|/)(?:download|pdf)(?:/|$)|(?:^|/)(?:invoice|receipt|statement)s?/[^/]+$')) AS bad,
    count(*) AS n
  FROM (SELECT page_id, unnest(hrefs[1:80]) AS h FROM p) GROUP BY 1)
SELECT p.page_id, CASE WHEN len(html) <= 2500 THEN 0 ELSE 1 END + 0 AS names, CASE WHEN len(html) > 750000 THEN 1 ELSE 0 END AS html, 1 + CASE
    WHEN p.page_id % 3 = 0 THEN 7 ELSE 0 END AS hosts, r.resources::INT AS resources, r.bodies::INT AS bodies, r.kept::INT AS kept,
  (coalesce(u.bad, 0) + greatest(len(hrefs) - 80, 0))::INT AS links, (coalesce(u.n, 0) - coalesce(u.bad, 0))::INT AS kept_links, CASE
      WHEN len(html) > 1000 THEN 1 ELSE 0 END AS counts, CASE WHEN len(html) <= 1000 THEN len(html) ELSE 0 END::INT AS n_html
FROM p JOIN r USING (page_id) LEFT JOIN u USING (page_id) WHERE secure""")
def evidence_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they report themselves: their own links, copies of their text as responses, some from elsewhere, names and counts that are long for long pages."""
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    origin, n = F.concat(F.lit("https://"), host), F.length("html")
    links = F.transform(
        scans.anchors(F.col("html")),
        lambda h: F.struct(F.concat(origin, h).alias("url"), F.lit("a  b").alias("label"), F.lit(None).cast("string").alias("context")),
    )
    resources = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(
        F.concat(
            F.when(i % 4 == 3, F.lit("https://elsewhere.example.com")).otherwise(origin), F.lit("/r/"), i.cast("string"),
        ).alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.repeat("html", i).alias("body"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("request_body"),
    ))
    hosts = F.concat(
        F.array(F.lit("cdn.example.com"), F.lit("localhost"), F.lit("cdn.example.com")),
        F.when(
            F.col("page_id") % 3 == 0,
            F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("h"), i.cast("string"), F.lit(".example.com"))),
        ).otherwise(F.array().cast("array<string>")),
    )
    rows = pages.select(
        "page_id", origin.alias("expected"), origin.alias("origin"), "url", F.when(
            n > 2500, F.repeat(F.lit("t"), F.lit(161)),
        ).otherwise("t").alias("title"), F.lit("app").alias("application"), F.lit(None).cast("string").alias("site"), "html",
        hosts.alias("hosts"), resources.alias("resources"), links.alias("links"), F.create_map(F.lit("html"), n).alias("counts"),
    )
    found = ingest.bounded(rows, "expected", resources=5)[0]
    return found.select(
        "page_id", *[f"dropped.{k}" for k in ("names", "html", "hosts", "resources", "bodies")], F.size("resources").alias("kept"), "dropped.links",
        F.size("links").alias("kept_links"), "dropped.counts", F.element_at("counts", "html").alias("n_html"),
    )


def _pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a PDF: what its copies differ in, and what they share."""
    key, stamp = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    data = text(
        "%PDF-1.4\n/CreationDate (D:", stamp, key, ") /ModDate(D:", stamp, ")\n/ID [ <", F.md5(key.cast("string")), "><", F.md5(stamp),
        "> ]\n/URI (https://invoice.stripe.com/i/acct/", key, ")\nstream\n/ModDate (D:12345) ", F.col("o_custkey"), F.col("o_orderstatus"),
        "\nendstream\n/ID [<1>] end",
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.encode(data, "ISO-8859-1").alias("data"))


_CONTENT = """SELECT o_orderkey, o_custkey,
    sha256('%PDF-1.4' || chr(10) || '/CreationDate (D:VOLATILE) /ModDate (D:VOLATILE)' || chr(10) || '/ID [<VOLATILE> <VOLATILE>]' || chr(10) || '/URI (https://invoice.stripe.com/i/VOLATILE)' || chr(10) || 'stream' || chr(10)
  || '/ModDate (D:12345) ' || o_custkey || o_orderstatus || chr(10) || 'endstream' || chr(10) || '/ID [<1>] end') AS content FROM orders"""


@query(f"WITH d AS ({_CONTENT}) SELECT content AS content_sha256, min(o_orderkey) AS first, count(*) AS n_copies FROM d GROUP BY 1")
def pdf_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ only in dates, file ids and links count as one."""
    docs = _pdf(spark, sf_dir)
    return identity.same_content(docs.withColumn("data", content.canonical_pdf(spark, "data")), F.col("data"), "o_orderkey")


@query(
    f"WITH d AS ({_CONTENT}), a AS (SELECT DISTINCT content FROM d WHERE o_orderkey % 50 = 0) SELECT DISTINCT 'o' || o_orderkey AS key FROM d JOIN a USING (content) WHERE o_orderkey % 3 > 0"
)
def key_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th order's content was accepted, and the keys of a third of all orders: the keys that are missing."""
    docs = _pdf(spark, sf_dir).select(
        text("o", F.col("o_orderkey")).alias("key"), F.sha2(content.canonical_pdf(spark, "data"), 256).alias("content_key"), "o_orderkey",
    )
    accepted = docs.where("o_orderkey % 50 = 0").select(F.col("content_key").alias("key")).unionByName(docs.where("o_orderkey % 3 = 0").select("key"))
    return identity.repaired(docs, accepted)


@query("""
WITH n AS (SELECT DISTINCT regexp_extract(trim(text), '^[^\\s]+') AS name FROM documents WHERE text IS NOT NULL)
SELECT name, row_number() OVER (ORDER BY name COLLATE en, name) AS place FROM n""")
def names_in_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of all documents, which are of four languages, as a reader expects them."""
    names = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.regexp_extract(F.trim("text"), r"^[^\s]+", 0).alias("name")).distinct()
    return ranking.in_locale_order(names, "name")
