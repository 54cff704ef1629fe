"""Registered queries of captured traffic: what may be kept of forms, pages and bodies, and references within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query, table
from .session import spread
from .sources import captures


@query("""
WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"[^>]*>', 1), lambda x: x <> ''
    AND NOT regexp_matches(x, '(?i)^\\s*(?:javascript|data|mailto|tel):')) AS links FROM pages),
c AS (SELECT page_id, list_transform(links, lambda x: replace(array_to_string(list_transform(string_split(x, ''), lambda c: CASE
    WHEN regexp_matches(c, '[!$-;=@-_a-z|~]') THEN c ELSE url_encode(c) END), ''), '&', '&amp;')) AS links FROM l)
SELECT page_id, coalesce(array_to_string(list_transform(list_filter(links, lambda x: len(x) <= 2048)[1:500],
    lambda x: '<a href="' || x || '"></a>'), ''), '') AS links FROM c WHERE links IS NOT NULL""")
def captured_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links are rooted paths here, without queries; other forms of addresses have tests."""
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", captures.html_links(F.col("html")).alias("links"))


@query("SELECT p_partkey, replace(p_name, ' ', '+') || '=REDACTED&' || replace(p_brand, '#', '%23') || '=REDACTED&p%25zz=REDACTED' AS form FROM part")
def captured_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same key comes twice, once with its blank as a plus; the last key has an escape that is none."""
    body = F.concat(
        F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("="), F.col("p_size").cast("string"), F.lit("&"), "p_brand", F.lit("="), "p_type",
        F.lit("&"), "p_name", F.lit("=again&&p%zz=1"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", captures.form_body(body).alias("form"))


@query("""
WITH o AS (SELECT *, o_orderkey::VARCHAR AS k, o_orderkey % 5 AS kind, o_orderkey % 35 = 0 AS long FROM orders)
SELECT o_orderkey,
  CASE WHEN long THEN 'truncated' ELSE ['json', 'malformed', 'form', 'multipart', 'text'][kind + 1] END AS outcome,
  CASE WHEN long THEN '{"__truncated__":true}' WHEN kind = 1 THEN '{"__malformed__":true}' WHEN kind = 2 THEN 'o' || k || '=REDACTED&status=REDACTED'
      WHEN kind = 3 THEN '[multipart body omitted]' WHEN kind = 4 THEN 'order ' || k || ' email: REDACTED'
    ELSE '{"id":"inv_' || k || '","account_id":' || o_custkey || ',"customerName":"REDACTED","created_at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","currency":"eur","total":' || round(o_totalprice * 100)::BIGINT || ',"status":"REDACTED","url":"https://x.se/customers/REDACTED/orders?page=1&priority=REDACTED","items":[{"memo":"REDACTED"}]}' END AS value,
  CASE WHEN kind = 0 AND NOT long THEN 'customerName,items.0.memo' ELSE '' END AS gone
FROM o""")
def captured_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bodies of five content types, some too long."""
    k, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    body = text(
        '{"id":"inv_', k, '","account_id":', F.col("o_custkey"), ',"customerName":"c', F.col("o_custkey"), '","created_at":"', F.date_format("o_orderdate", "yyyy-MM-dd"), '","currency":"eur","total":', F.round(F.col("o_totalprice") * 100).cast("long"),
        ',"status":"', F.col("o_orderstatus"), '","url":"https://x.se/customers/', F.lower("o_orderstatus"), 'clerk/orders?page=1&priority=', F.col("o_orderpriority"), '","items":[{"memo":"4111 1111 1111 1111"}]}',
    )
    told = F.when(kind == 0, body).when(kind == 1, text('{"id":', k)).when(
        kind == 2, text("o", k, "=1&status=", F.col("o_orderstatus")),
    ).when(kind == 3, text("--b\r\n", k, "\r\n--b--")).otherwise(text("order ", k, " email: c", F.col("o_custkey"), "@x.se"))
    types = F.array(
        *map(F.lit, ("application/json", "application/vnd.api+json; v=1", "application/x-www-form-urlencoded", "multipart/form-data; boundary=b", "text/plain"))
    )
    rows = spread(table(spark, sf_dir, "orders")).select(
        "o_orderkey", F.get(types, kind.cast("int")).alias("type"),
        F.concat(told, F.when(F.col("o_orderkey") % 35 == 0, F.repeat(F.lit(" "), F.lit(500))).otherwise("")).alias("body"),
    )
    found = captures.sanitised_bodies(rows, "body", "type", most=500)
    return found.select("o_orderkey", "body.outcome", "body.value", F.array_join("body.gone", ",").alias("gone"))


@query("""
WITH e AS (SELECT user_id, event_id, 'acct' || lpad((event_id % 13)::VARCHAR, 12, '0') AS a, (1000000 + event_id * 7 % 31)::VARCHAR AS b,
    (1000000 + event_id % 97)::VARCHAR AS c FROM events),
s AS (SELECT user_id, t, min((event_id, p)) AS first_at FROM (SELECT user_id, event_id, unnest([a, b, c]) AS t, unnest([0, 1, 2]) AS p FROM e) GROUP BY 1, 2),
n AS (SELECT user_id, t, 'ref_' || row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS ref FROM s)
SELECT e.user_id, event_id, 'https://a.se/t?id=__' || z.ref || '__' AS url, '{"account_id":"' || x.ref || '","items":[{"id":"' || y.ref || '"}]}' AS value, 'account_id=' || x.ref || ',items.0.id=' || y.ref AS refs
FROM e JOIN n x ON x.user_id = e.user_id AND x.t = a JOIN n y ON y.user_id = e.user_id AND y.t = b JOIN n z ON z.user_id = e.user_id AND z.t = c""")
def capture_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a session whose identifiers are numbered by first sight."""
    id = F.col("event_id")
    url = F.concat(F.lit("https://a.se/t?id="), (1000000 + id % 97).cast("string"))
    body = F.concat(
        F.lit('{"account_id":"acct'), F.lpad((id % 13).cast("string"), 12, "0"), F.lit('","items":[{"id":'), (1000000 + id * 7 % 31).cast("string"),
        F.lit("}]}"),
    )
    rows = spread(table(spark, sf_dir, "events").select("user_id", "event_id")).select("user_id", "event_id", url.alias("u"), body.alias("b"), F.lit("application/json").alias("t"))
    found = captures.captured(rows, "user_id", ["event_id"], "u", "b", "t")
    return found.select("user_id", "event_id", "url", "value", F.array_join("refs", ",").alias("refs"))
