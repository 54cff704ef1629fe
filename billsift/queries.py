"""The registered queries over the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import transforms, urls, values
from .operators import evidence, identity, inference, ledger, outcomes, ranking, retrieval
from .plans import recipe
from .session import shared_dir, spread
from .sources import scans
from .streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = "1998-06-15"
MONTH = "1998-06"


def query(sql: str | None = None):
    def keep(run: Callable) -> Callable:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Evidence


def _flag_weight() -> Column:
    return F.when(F.col("l_linestatus") == "F", 3).otherwise(2)


@query("""
WITH c AS (SELECT l_orderkey, l_returnflag AS v, max(CASE WHEN l_linestatus = 'F' THEN 3 ELSE 2 END) AS w, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY w DESC, n DESC) AS k FROM c)
SELECT l_orderkey, CASE WHEN count(*) = 1 THEN min(v) END AS value, CASE WHEN count(*) = 1 THEN min(n) END AS n_claims, count(*) > 1 AS conflict FROM r WHERE k = 1 GROUP BY 1""")
def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("value"), _flag_weight().alias("weight"))
    return evidence.resolve(claims, ["l_orderkey"])


@query("""
WITH c AS (SELECT l_orderkey, 'l_returnflag' AS f, l_returnflag AS v, CASE WHEN l_linestatus = 'F' THEN 3 ELSE 2 END AS w FROM lineitem
  UNION ALL SELECT l_orderkey, 'l_linestatus', l_linestatus, CASE WHEN l_linestatus = 'F' THEN 3 ELSE 2 END FROM lineitem),
g AS (SELECT l_orderkey, f, v, max(w) AS w, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey, f ORDER BY w DESC, n DESC) AS k FROM g),
t AS (SELECT l_orderkey, f, count(*) > 1 AS bad, min(v) AS v FROM r WHERE k = 1 GROUP BY 1, 2)
SELECT l_orderkey, coalesce(string_agg(f || '=' || v, ',' ORDER BY f) FILTER (NOT bad), '') AS fields, coalesce(string_agg(f, ',' ORDER BY f) FILTER (bad), '') AS conflicts FROM t GROUP BY 1""")
def evidence_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = evidence.fields_as_claims(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"], _flag_weight())
    return evidence.conflicts(evidence.resolve(claims, ["l_orderkey", "field"]), ["l_orderkey"])


@query("""
WITH c AS (SELECT l_orderkey, strftime(l_shipdate, '%Y-%m') AS v, max(CASE WHEN l_linestatus = 'F' THEN 3 ELSE 2 END) AS w, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY w DESC, n DESC) AS k FROM c)
SELECT l_orderkey, CASE WHEN count(*) = 1 THEN min(v) END AS month, count(*) > 1 AS conflict FROM r WHERE k = 1 GROUP BY 1""")
def issue_month_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.issue_month(table(spark, sf_dir, "lineitem").withColumn("weight", _flag_weight()), ["l_orderkey"], "l_shipdate")


# Identities


@query("SELECT o_orderkey, sha256(o_custkey::VARCHAR || chr(0) || 'orders' || chr(0) || o_orderkey::VARCHAR) AS key FROM orders")
def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.identity_key(text("o_custkey"), F.lit("orders"), text("o_orderkey")).alias("key"))


@query("SELECT sha256(coalesce(text, '')) AS content_sha256, min(doc_id) AS first, count(*) AS n_copies FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.same_content(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 10 THEN l_partkey::VARCHAR END AS d FROM lineitem),
p AS (SELECT *, coalesce(d, 'position:' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber)) AS told FROM l),
m AS (SELECT l_orderkey, l_linenumber, count(DISTINCT told) > 1 AS many FROM p GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN many THEN l_linenumber::VARCHAR || '-' || substr(sha256(coalesce(d, 'position:' || l_partkey)), 1, 24) ELSE l_linenumber::VARCHAR END AS l_linenumber_unique
FROM l JOIN m USING (l_orderkey, l_linenumber)""")
def disambiguate_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("d"))
    return identity.disambiguate(lines, ["l_orderkey"], "l_linenumber", F.col("d"), F.col("l_partkey")).drop("d")


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_STABLE = f"CASE WHEN {_HOST} = '' THEN -1 WHEN lower({_PATH}) LIKE '%.pdf' THEN 3 WHEN regexp_matches(lower({_PATH}), '(?:^|/)pdf(?:/|$)') THEN 2 WHEN regexp_matches(lower({_PATH}), '(?:^|/)download(?:/|$)') THEN 1 ELSE 0 END"


@query(f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, {_STABLE} AS s FROM pages)
SELECT host, min(page_id) AS page_id, (array_agg(url ORDER BY s DESC, page_id))[1] AS url FROM p WHERE host <> '' GROUP BY 1""")
def dedup_keep_first_best_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", urls.host_of(F.col("url")).alias("host"))
    return identity.keep_first(rows, ["host"], ["page_id"], [("url", urls.stability_score(F.col("url")))])


def _refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    refs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"), key("o", "o_orderkey").alias("key"), F.array(key("c", "o_custkey")).alias("aliases"),
    )
    seen = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.explode(F.array(key("c", "user_id"), key("o", "event_id"))).alias("key"))
    return refs, seen


_SEEN = "WITH s AS (SELECT DISTINCT unnest(['c' || user_id, 'o' || event_id]) AS k FROM events WHERE event_type = 'purchase')"


@query(
    f"{_SEEN} SELECT o_orderkey AS pos, 'o' || o_orderkey AS key FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT k FROM s) AND 'c' || o_custkey NOT IN (SELECT k FROM s)"
)
def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.unseen(*_refs(spark, sf_dir), aliases="aliases").select("pos", "key")


@query(
    f"{_SEEN} SELECT DISTINCT 'o' || o_orderkey AS key FROM orders WHERE 'c' || o_custkey IN (SELECT k FROM s) AND 'o' || o_orderkey NOT IN (SELECT k FROM s)"
)
def alias_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.migrated(*_refs(spark, sf_dir))


@query("""
WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey AS p, list_distinct(['n' || (o_orderkey * 13 % 23), 'n' || (o_orderkey * 7 % 31), 'n' || (o_orderkey * 5 % 29)]) AS names, 'n' || (o_orderkey * 13 % 23) AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
s(o_custkey, i, p, kept, held) AS (
  SELECT DISTINCT o_custkey, 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[] FROM r
  UNION ALL
  SELECT s.o_custkey, r.i, r.p, NOT list_has_any(s.held, r.names), CASE WHEN list_has_any(s.held, r.names) THEN list_distinct(list_append(s.held, r.key)) ELSE list_concat(s.held, r.names) END FROM s JOIN r ON r.o_custkey = s.o_custkey AND r.i = s.i + 1)
SELECT p AS pos, o_custkey FROM s WHERE kept""")
def emitted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders under a name and two others that meet those of earlier orders in part."""
    key = F.col("o_orderkey")
    name = lambda a, n: F.concat(F.lit("n"), (key * a % n).cast("string"))
    refs = table(spark, sf_dir, "orders").select("o_custkey", key.alias("pos"), name(13, 23).alias("key"), F.array(name(7, 31), name(5, 29)).alias("aliases"))
    return identity.emitted_once(refs, ["o_custkey"]).select("pos", "o_custkey")


# Ledger


@query("""
WITH a AS (SELECT o_custkey AS k, min(o_orderdate) AS at, max(o_totalprice) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
b AS (SELECT o_custkey AS k, min(o_orderdate) AS at, max(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, strftime(least(a.at, b.at), '%Y-%m-%d') AS at, coalesce(b.total, a.total) AS total FROM a FULL JOIN b ON a.k = b.k""")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    part = lambda c: orders.where(c).groupBy(F.col("o_custkey").alias("k")).agg(
        F.min("o_orderdate").alias("at"), F.max("o_totalprice").alias("total"),
    )
    merged = ledger.upsert(part("o_orderstatus <> 'P'"), part("o_orderstatus = 'P'"), ["k"], earliest=["at"])
    return merged.withColumn("at", F.date_format("at", "yyyy-MM-dd"))


@query("""
SELECT l_suppkey, max(s_name) AS vendor_name, strftime(max(l_shipdate), '%Y-%m-%d') AS latest, count(*) AS n_entries, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS total
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def ledger_group_by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    named = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return ledger.by_vendor(named, "l_suppkey", "s_name", "l_shipdate", "cents").withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@query(f"""
SELECT o_orderkey, o_orderdate::DATE BETWEEN DATE '{TODAY}' - 30 AND DATE '{TODAY}' AS last_30d, o_orderdate::DATE BETWEEN DATE '{TODAY}' - 90 AND DATE '{TODAY}' AS last_90d,
  o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '{TODAY}' AS this_year FROM orders""")
def ledger_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, today = F.to_date("o_orderdate"), F.lit(TODAY).cast("date")
    flags = {"last_30d": "30d", "last_90d": "90d", "this_year": "year"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[ledger.in_range(day, today, r).alias(n) for n, r in flags.items()])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000")
def ledger_newest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(table(spark, sf_dir, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def seen_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(table(spark, sf_dir, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 20, ["user_id"]).select("user_id", "event_id")


@query(f"""
SELECT o_custkey, count(*) FILTER (strftime(o_orderdate, '%Y-%m') = '{MONTH}') AS matched, count(*) FILTER (strftime(o_orderdate, '%Y-%m') < '{MONTH}') AS before,
  count(*) FILTER (strftime(o_orderdate, '%Y-%m') > '{MONTH}') AS after, count(*) FILTER (o_orderdate IS NULL) AS undated, count(*) FILTER (o_orderdate IS NULL) = 0 AS filtered FROM orders GROUP BY 1""")
def month_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.month_counts(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate"), MONTH)


_UNDATED = "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' AND o_totalprice > 400000 THEN NULL ELSE o_orderdate END"


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, {_UNDATED} AS d FROM orders), u AS (SELECT DISTINCT o_custkey FROM o WHERE d IS NULL)
SELECT o_orderkey, o_custkey FROM o WHERE o_custkey IN (SELECT o_custkey FROM u) OR strftime(d, '%Y-%m') = '{MONTH}'""")
def month_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(_UNDATED).alias("d"))
    return ledger.month_filter(orders, ["o_custkey"], F.col("d"), MONTH).select("o_orderkey", "o_custkey")


# Retrieval


_WALK = """
WITH p AS (SELECT conv_id, turn, turn < max(turn) OVER (PARTITION BY conv_id) AS more, (len(text) // 40)::VARCHAR AS st, role FROM conversations WHERE turn < 20),
q AS (SELECT *, min(turn) FILTER (more) OVER (PARTITION BY conv_id, st) AS f FROM (
  SELECT c.conv_id, c.turn, c.role, (len(c.text) // 40)::VARCHAR AS st, c.turn < m.last AS more FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) m USING (conv_id) WHERE c.turn < 20)),
c AS (SELECT *, CASE WHEN NOT more THEN 'explicit_end' WHEN trim(coalesce(st, '')) = '' THEN 'continuation_failed' WHEN f < turn THEN 'repeated_state' WHEN turn = 19 THEN 'page_cap' END AS cause FROM q),
e AS (SELECT conv_id, min(turn) AS turn FROM c WHERE cause IS NOT NULL GROUP BY 1),
w AS (SELECT c.conv_id, coalesce(max(CASE WHEN c.turn = e.turn THEN c.cause END), 'continuation_failed') AS termination, count(*) AS n_pages, count(*) AS observed, count(*) FILTER (role = 'assistant') AS resolved
  FROM c LEFT JOIN e USING (conv_id) WHERE e.turn IS NULL OR c.turn <= e.turn GROUP BY 1)"""


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pages = turns.join(last, "conv_id")
    return retrieval.walked(pages, "conv_id", "turn", F.col("turn") < F.col("last"), F.floor(F.length("text") / 40).cast("string"), F.lit(1))


@query(_WALK + " SELECT conv_id, termination, n_pages, observed::BIGINT AS observed FROM w")
def pagination_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir)


_PROOF = """SELECT conv_id, termination, CASE WHEN termination = 'explicit_end' AND observed = n_user + n_assistant AND n_system = 0 THEN 'complete' ELSE 'partial' END AS completeness, least(greatest(n_pages, 1), 100) AS pages_visited, observed AS observed_items,
  CASE WHEN observed = n_user + n_assistant + n_system THEN n_user + n_assistant ELSE 0 END AS resolved_items, CASE WHEN observed = n_user + n_assistant + n_system THEN n_system ELSE observed END AS unresolved_items
FROM w JOIN (SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system FROM conversations GROUP BY 1) USING (conv_id)"""


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role").isin("user", "assistant")).alias("known"), F.count_if(F.col("role") == "system").alias("rest"),
    )
    joined = _walked(spark, sf_dir).join(roles, "conv_id")
    return retrieval.proof(joined, F.col("termination"), F.col("n_pages"), F.col("observed"), F.col("known"), F.col("rest"))


@query(_WALK + _PROOF)
def retrieval_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proofs(spark, sf_dir).select("conv_id", "termination", "completeness", "pages_visited", "observed_items", "resolved_items", "unresolved_items")


@query(_WALK + f", f AS ({_PROOF})" + """
SELECT count(*) AS total, count(*) FILTER (completeness = 'complete') AS complete, count(*) FILTER (completeness = 'partial') AS partial, sum(observed_items)::BIGINT AS observed,
  sum(resolved_items)::BIGINT AS resolved, sum(unresolved_items)::BIGINT AS unresolved, string_agg(DISTINCT termination, ',' ORDER BY termination) AS terminations FROM f""")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.summary(_proofs(spark, sf_dir))


@query("""
SELECT r_regionkey, n_name AS nation, s AS status FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT unnest(['open', 'paid']) AS s)""")
def scope_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    status = table(spark, sf_dir, "region").select(
        "r_regionkey", F.lit("status").alias("option"), F.explode(F.array(F.lit("open"), F.lit("paid"))).alias("value"),
    )
    options = nations.select("r_regionkey", F.lit("nation").alias("option"), F.col("n_name").alias("value")).unionByName(status)
    return retrieval.scopes(options, ["r_regionkey"], "option", "value", ["value"]).select(
        "r_regionkey", F.col("scope")["nation"].alias("nation"), F.col("scope")["status"].alias("status"),
    )


@query("""
WITH r AS (SELECT DISTINCT n_nationkey AS k FROM nation), e AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT k, 'missing' AS problem FROM r WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT k, 'orphan' FROM e WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT k, 'duplicate' FROM e WHERE n > 1""")
def lifecycle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.coverage(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")),
        table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k",
    )


# Recipes and scans


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.k'), '') <> '' AS present FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.try_parse_json("props")
    seen = recipe.predicate({"kind": "jsonPath", "path": "k"}, F.lit(200), body)
    return table(spark, sf_dir, "events").select("event_id", scans.at_path(body, "k").alias("k"), seen.alias("present"))


@query("""
SELECT o_orderkey, printf('%.2f', round(o_totalprice * 100)::BIGINT / 100.0) AS total, strftime(o_orderdate, '%Y-%m-%d') AS issued, split_part(o_orderpriority, '-', 1) AS rank,
  'order-' || o_orderkey || '.pdf' AS file, lower(regexp_replace(o_orderpriority, '(\\d)-', 'P\\1 ')) AS label FROM orders""")
def transform_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    steps = lambda c, *s: transforms.applied(c, s)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", steps(cents, {"kind": "divide", "by": 100}).alias("total"), steps(
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), {"kind": "date", "epoch": "s"},
        ).alias("issued"),
        steps(F.col("o_orderpriority"), {"kind": "regex", "pattern": r"^(\d)-", "group": 1}).alias("rank"), steps(
            F.col("o_orderkey").cast("string"), {"kind": "template", "text": "order-{value}.pdf"},
        ).alias("file"),
        steps(F.col("o_orderpriority"), {"kind": "replace", "pattern": r"(\d)-", "with": "P$1 "}, {"kind": "lower"}).alias("label"),
    )


@query("SELECT o_orderkey, 'https://api.example/c/' || o_custkey || '/orders/' || o_orderkey || '?s=' || o_orderstatus AS url FROM orders")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"customer": F.col("o_custkey"), "order": F.col("o_orderkey"), "status": F.col("o_orderstatus")}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", transforms.rendered("https://api.example/c/{customer}/orders/{order}?s={status}", names).alias("url"),
    )


def _portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTML page for each order: data scripts, a receipt row and links."""
    key = F.col("o_orderkey").cast("string")
    blob = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    key.alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"),
                )
            ).alias("invoices")
        )
    )
    html = F.concat(
        F.lit(
            "<html><title>Billing</title><script type=\"application/json\">{broken</script><script type=\"application/json\">"
        ), F.replace(blob, F.lit('"'), F.lit("&quot;")),
        F.lit('</script><table><tr class="r"><td>'), key, F.lit("</td><td>"), F.col("o_orderstatus"), F.lit('</td></tr></table><a href="/receipts/'), key, F.lit(
            '.pdf">Receipt</a><a href="/terms.pdf">Terms</a></html>'
        ),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", html.alias("body"))


@query(
    "SELECT o_orderkey, 0::BIGINT AS pos, o_orderkey::VARCHAR AS id, printf('%.2f', round(o_totalprice * 100)::BIGINT / 100.0) AS total, strftime(o_orderdate, '%Y-%m-%d') AS issued FROM orders"
)
def json_embedded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = recipe.Recipe(
        "orders", "embedded", "invoices",
        {
            "id": recipe.Extract("id"), "total": recipe.Extract("cents", [{"kind": "divide", "by": 100}]),
            "issuedAt": recipe.Extract("issued", [{"kind": "date"}]),
        },
    )
    found, _ = recipe.refs(shape, _portal(spark, sf_dir))
    return found.select("o_orderkey", F.col("pos").cast("long").alias("pos"), "id", "total", F.col("issuedAt").alias("issued"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS id, o_orderstatus AS status FROM orders")
def row_regex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.regex_rows(
        _portal(spark, sf_dir), "body", r'<tr class="r"><td>(?<id>[^<]*)</td><td>(?<status>[^<]*)</td>',
    ).select("o_orderkey", "id", "status")


@query("SELECT o_orderkey, 'https://billing.example.com/receipts/' || o_orderkey || '.pdf' AS link, 'Receipt' AS label FROM orders")
def likely_document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    portal = spread(_portal(spark, sf_dir)).withColumn("base", F.lit("https://billing.example.com/account/history"))
    return scans.document_links(portal, "body", "base").select("o_orderkey", "link", "label")


@query(
    """SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '\\bhref="([^"]+)"', 1) AS h FROM pages)"""
)
def anchor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(scans.anchors(F.col("html"))).alias("pos", "href"),
    ).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT page_id, {_HOST} AS host, contains({_HOST}, '.') AND NOT regexp_matches({_HOST}, '(?:^|\\.)(?:localhost|local)$') AS public FROM pages")
def public_host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = urls.host_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), urls.is_public_host(host).alias("public"))


@query(f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda kv: regexp_matches(kv, '^(?:page|offset|limit|per_page|cursor)=\\d+$'))) AS q FROM pages)
SELECT page_id, CASE WHEN url LIKE 'https://%' AND contains(host, '.') AND NOT regexp_matches(host, '(?:^|\\.)(?:localhost|local)$') AND NOT regexp_matches(lower(path), '{urls.UNSAFE}') AND NOT regexp_matches(lower(path), '{urls.DIRECT_DOCUMENT}')
  AND NOT regexp_matches(url, '^[^/]*//[^/?#]*@') THEN 'https://' || host || path || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END END AS route FROM p""")
def safe_route_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.safe_route(F.col("url")).alias("route"))


@query(f"""
WITH p AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[1:12] AS s FROM pages),
t AS (SELECT page_id, '/' || coalesce(array_to_string(list_transform(s, lambda x: CASE WHEN regexp_full_match(lower(x), '{urls.ROUTE_WORDS}') THEN lower(x) WHEN regexp_full_match(lower(x), '{urls.ROUTE_ID}') THEN ':id' ELSE ':segment' END), '/'), '') AS r FROM p)
SELECT page_id, CASE WHEN len(r) <= 160 THEN r ELSE '/:segment' END AS template FROM t""")
def route_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.route_template(F.col("url")).alias("template"))


# Ranking


_TITLE = r"substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 1, 160)"
_PARTS = f"""
p AS (SELECT DISTINCT {_HOST} AS host, {_TITLE} AS t FROM pages),
f AS (SELECT DISTINCT host, t, trim(unnest(string_split(t, ' '))) AS name FROM p WHERE t <> ''),
c AS (SELECT host, name, count(*) AS n_titles FROM f WHERE name <> '' GROUP BY 1, 2)"""


@query(f"""WITH {_PARTS}
SELECT host, name, n_titles FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n_titles DESC, len(name), name) AS k FROM c WHERE n_titles >= 2) WHERE k = 1""")
def supplier_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words take the place of title fragments: these pages' titles have no separators."""
    cut = F.regexp_replace(scans.title_of(F.col("html")), " ", " | ")
    seen = table(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("host"), cut.alias("title"))
    return ranking.stable_names(seen, ["host"])


_TARGETS = f"""
t AS (SELECT page_id, host, href, CASE WHEN regexp_matches(href, '(?i)^/[a-f]') THEN 'a' WHEN regexp_matches(href, '(?i)^/[g-s]') THEN 'b' ELSE 'c' END AS family,
  CASE WHEN href = '/the' THEN 'remembered' WHEN href LIKE '/and%' THEN 'common_route' ELSE 'link' END AS source, max(len(href)) AS score
  FROM (SELECT page_id, {_HOST} AS host, unnest(regexp_extract_all(html, '\\bhref="([^"]+)"', 1)) AS href FROM pages) GROUP BY ALL)"""


@query(f"""WITH {_TARGETS},
k AS (SELECT *, CASE source WHEN 'remembered' THEN 0 WHEN 'common_route' THEN 1 ELSE 2 END AS kind, CASE WHEN source = 'link' THEN family ELSE '' END AS fam FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind, fam ORDER BY score DESC, href COLLATE en, href) AS turn FROM k)
SELECT page_id, href AS url, row_number() OVER (PARTITION BY page_id ORDER BY kind, turn, fam) AS rank FROM n""")
def frontier_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(scans.anchors(F.col("html")))).alias("url"))
    family = F.when(F.col("url").rlike("(?i)^/[a-f]"), "a").when(F.col("url").rlike("(?i)^/[g-s]"), "b").otherwise("c")
    source = F.when(F.col("url") == "/the", "remembered").when(F.col("url").startswith("/and"), "common_route").otherwise("link")
    targets = links.select("page_id", "url", family.alias("family"), source.alias("source"), F.length("url").alias("score"))
    return ranking.frontier(targets, ["page_id"]).select("page_id", "url", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH s AS (SELECT page_id, {_HOST} AS host, CASE WHEN url LIKE 'https%' THEN 200 ELSE 100 END + least(len(url), 40) + least(len(regexp_extract_all(html, '\\bhref="([^"]+)"', 1)), 25) AS score FROM pages)
SELECT host, page_id, score::BIGINT AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS k FROM s) WHERE k <= 3""")
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    adapter = F.when(F.col("url").startswith("https"), "embedded-json").otherwise("dom-links")
    score = ranking.candidate_score(adapter, F.length("url"), F.size(scans.anchors(F.col("html")))).cast("long")
    rows = table(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("host"), "page_id", score.alias("score"))
    return ranking.top_k(rows, ["host"], [F.col("score").desc(), F.col("page_id")], 3).withColumn("rank", F.col("rank").cast("long"))


# Private data


def _redacted_sql() -> str:
    """The chain of replacements in DuckDB's dialect, where a border is \\b (ASCII) instead of a look-around."""
    out = "text"
    for pattern, by in values.REDACTIONS:
        border = pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("'", "''")
        out = f"regexp_replace({out}, '{border}', '{by.replace('$', chr(92))}', 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents"


@query(_redacted_sql())
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", values.redacted(F.col("text")).alias("text"))


@query("""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, text, regexp_extract_all(text, '[A-Za-z0-9_-]{24,}') AS found, string_split_regex(text, '[A-Za-z0-9_-]{24,}') AS pieces FROM documents),
f AS (SELECT r, x, min(i) AS place FROM (SELECT r, unnest(found) AS x, unnest(range(len(found))) AS i FROM t) GROUP BY 1, 2),
n AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY place) AS k FROM f),
p AS (SELECT r, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM t),
m AS (SELECT r, unnest(found) AS x, unnest(range(len(found))) AS i FROM t),
j AS (SELECT p.r, string_agg(piece || coalesce('REDACTED_VALUE_' || n.k, ''), '' ORDER BY p.i) AS text FROM p LEFT JOIN m ON m.r = p.r AND m.i = p.i LEFT JOIN n ON n.r = m.r AND n.x = m.x GROUP BY 1)
SELECT doc_id, coalesce(j.text, t.text) AS text FROM t LEFT JOIN j USING (r)""")
def pii_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", values.aliased_tokens(F.col("text")).alias("text"))


@query(r"""
WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\b(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})\b'), lambda x: regexp_replace(x, '\D', '', 'g')) AS d FROM documents),
l AS (SELECT doc_id, list_filter(d, lambda x: list_sum(list_transform(range(len(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[len(x) - i]::INT ELSE CASE WHEN x[len(x) - i]::INT * 2 > 9 THEN x[len(x) - i]::INT * 2 - 9 ELSE x[len(x) - i]::INT * 2 END END)) % 10 = 0) AS ok FROM c)
SELECT doc_id, coalesce(len(ok), 0)::BIGINT AS n_cards FROM l""")
def payment_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.size(values.card_numbers(F.col("text"))), F.lit(0)).cast("long").alias("n_cards"))


# Outcomes, schedules, state


_STATUS = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN CASE WHEN value > 40 THEN 401 ELSE 302 END WHEN 'purchase' THEN 403 WHEN 'signup' THEN 0 ELSE 503 END"


@query(f"""
WITH s AS (SELECT event_id, {_STATUS} AS st, event_type = 'click' AS redirected, value < 60 AS ok FROM events)
SELECT event_id, CASE WHEN st = 0 THEN 'transport_failed' WHEN redirected THEN 'session_expired' WHEN st = 401 THEN 'session_expired' WHEN st = 407 THEN 'transport_failed' WHEN st = 403 THEN 'insufficient_scope'
  WHEN st IN (408, 425) OR st >= 500 THEN 'transport_failed' WHEN ok THEN 'authenticated' ELSE 'blocked_or_challenged' END AS outcome FROM s""")
def auth_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = values.auth_outcome(F.expr(_STATUS), F.col("event_type") == "click", F.col("value") < 60)
    return table(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"))


_CAUSE = "CASE event_type WHEN 'view' THEN 'selector_miss' WHEN 'click' THEN 'auth_expired' WHEN 'purchase' THEN 'document_too_large' WHEN 'signup' THEN 'transport_failed' ELSE 'gremlins' END"
_CODES = ", ".join(f"('{k}', '{s}', '{c}')" for k, (s, c) in values.CAUSES.items())


@query(f"""
WITH m(cause, stage, code) AS (VALUES {_CODES})
SELECT user_id, coalesce(stage, 'unknown') AS stage, coalesce(code, 'unknown') AS code, count(*) AS n FROM (SELECT user_id, {_CAUSE} AS cause FROM events) e LEFT JOIN m USING (cause) GROUP BY 1, 2, 3""")
def error_code_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    causes = table(spark, sf_dir, "events").select("user_id", F.expr(_CAUSE).alias("cause"))
    return outcomes.classified(causes, "cause").groupBy("user_id", "stage", "code").agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error') AS good FROM events GROUP BY 1),
f AS (SELECT user_id, count(*) AS n FROM events JOIN g USING (user_id) WHERE good IS NULL OR (ts, event_id) > good GROUP BY 1)
SELECT user_id, coalesce(n, 0) AS failures, CASE WHEN n IS NULL THEN NULL WHEN n = 1 THEN 300 WHEN n = 2 THEN 1800 ELSE 7200 END AS delay_s FROM g LEFT JOIN f USING (user_id)""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = outcomes.failures_in_row(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return runs.select("user_id", "failures", values.retry_delay(F.lit("transport_failed"), F.col("failures")).alias("delay_s"))


@query(
    "SELECT event_id, epoch(ts)::BIGINT + least(greatest(floor(value)::BIGINT * 1000, 5), 86400) AS until FROM (SELECT event_id, date_trunc('second', ts) AS ts, value FROM events)"
)
def rate_limit_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", values.rate_limit_until(F.unix_seconds(F.col("ts").cast("timestamp")), F.floor("value") * 1000).alias("until"),
    )


@query("""
WITH RECURSIVE r AS (SELECT user_id, ts, event_id, event_type = 'view' AS ok, json_extract_string(props, '$.k') AS route FROM events),
e AS (SELECT user_id, ok, route, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM r WHERE NOT ok OR route IS NOT NULL),
s(user_id, i, route, previous, misses) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT FROM e
  UNION ALL
  SELECT s.user_id, e.i,
    CASE WHEN e.ok THEN e.route WHEN s.misses + 1 >= 3 THEN s.previous ELSE s.route END,
    CASE WHEN e.ok THEN CASE WHEN s.route IS NULL THEN NULL WHEN s.route <> e.route THEN s.route ELSE s.previous END WHEN s.misses + 1 >= 3 THEN NULL ELSE s.previous END,
    CASE WHEN e.ok OR s.route IS NULL OR s.misses + 1 >= 3 THEN 0 ELSE s.misses + 1 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, route, previous, misses FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM s) WHERE k = 1 AND route IS NOT NULL""")
def route_memory_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.route_memory(
        table(spark, sf_dir, "events").withColumn("route", F.get_json_object("props", "$.k")), ["user_id"], ["ts", "event_id"], "route",
        F.col("event_type") == "view",
    )


@query("""
SELECT o_orderkey, strftime(CASE WHEN at31 > o_orderdate THEN at31 ELSE at31n END, '%Y-%m-%d %H') AS monthly, strftime(o_orderdate::DATE + INTERVAL 9 HOUR, '%Y-%m-%d %H') AS daily,
  strftime(o_orderdate::DATE + ((1 - dayofweek(o_orderdate) + 7) % 7)::INT + INTERVAL 9 HOUR, '%Y-%m-%d %H') AS weekly
FROM (SELECT o_orderkey, o_orderdate, last_day(o_orderdate) + INTERVAL 9 HOUR AS at31, last_day(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) + INTERVAL 9 HOUR AS at31n FROM orders)""")
def next_sync_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.col("o_orderdate").cast("timestamp")
    at = lambda mode, day: F.date_format(values.next_run(mode, now, day), "yyyy-MM-dd HH")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", at("monthly", 31).alias("monthly"), at("daily", 1).alias("daily"), at("weekly", 1).alias("weekly"),
    )


@query(
    "SELECT user_id, coalesce(max(ts) FILTER (event_type = 'view') > max(ts) FILTER (event_type = 'error'), max(ts) FILTER (event_type = 'error') IS NULL) AS healthy FROM events GROUP BY 1"
)
def attention_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(last("view") > last("error"), last("error").isNull()).alias("healthy"))


# Inference


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON body for each customer with orders, as a portal would list them."""
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued_at"),
        F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") * 100).cast("long")).alias("amount"),
    )
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.struct(F.struct(F.col("items")).alias("data"), F.struct(F.lit("abc123").alias("next_cursor"), F.lit(True).alias("has_more")).alias("page"))
    return listed.select("o_custkey", F.to_json(body).alias("body"))


@query(
    "SELECT o_custkey, 'data.items' AS list, count(*) AS n_items, round(avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END), 9) AS score FROM orders GROUP BY 1"
)
def invoice_array_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = inference.array_scores(inference.leaves(_bodies(spark, sf_dir), "body"), ["o_custkey"])
    return scores.withColumn("score", F.round("score", 9))


@query("""
WITH RECURSIVE k(user_id, event_type, ts) AS (
  SELECT user_id, event_type, min(ts) FROM events GROUP BY 1, 2
  UNION ALL
  SELECT k.user_id, k.event_type, min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 300 SECOND GROUP BY 1, 2)
SELECT min(event_id) AS event_id, user_id, event_type FROM k JOIN events USING (user_id, event_type, ts) GROUP BY user_id, event_type, ts""")
def stream_dedup_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events deduplicated in a stream by user and type within a lease, run to its end into a Parquet table in the shared folder."""
    import uuid

    path = f"{shared_dir(spark)}/leased-{uuid.uuid4().hex}"
    events = state.event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    kept = state.leased(events, ["user_id", "event_type"], ties=["event_id"]).select("event_id", "user_id", "event_type")
    run = kept.writeStream.format("parquet").option(
        "checkpointLocation", f"{path}/checkpoint",
    ).trigger(availableNow=True).outputMode("append").start(f"{path}/rows")
    run.awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{path}/rows")


# The flagship: invoices of orders with resolved evidence, identity and month


@query("""
WITH c AS (SELECT l_orderkey, l_returnflag AS v, max(CASE WHEN l_linestatus = 'F' THEN 3 ELSE 2 END) AS w, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY w DESC, n DESC) AS k FROM c),
e AS (SELECT l_orderkey, CASE WHEN count(*) = 1 THEN min(v) END AS value, count(*) > 1 AS conflict FROM r WHERE k = 1 GROUP BY 1)
SELECT o_orderkey, sha256(o_custkey::VARCHAR || chr(0) || 'orders' || chr(0) || o_orderkey::VARCHAR) AS key, strftime(o_orderdate, '%Y-%m') AS month, value, coalesce(conflict, false) AS conflict
FROM orders LEFT JOIN e ON l_orderkey = o_orderkey""")
def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    resolved = evidence_resolution(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", "value", "conflict")
    refs = table(spark, sf_dir, "orders").select(
        "o_orderkey", values.identity_key(text("o_custkey"), F.lit("orders"), text("o_orderkey")).alias("key"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )
    return refs.join(resolved, "o_orderkey", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
