"""Registered queries of the search for documents: controls, row claims, enumeration, states, walks and redaction, each with its SQL for DuckDB.

As in `queries_rules`, inputs that the tables lack are picked from a list by a row's id, alike in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import controls, exploration
from .operators import actions
from .queries import query, table
from .queries_rules import _case, _list, _pick
from .session import spread
from .sources import walks

# Controls and rows

def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a portal's table: a number under its header, in the row's text alone, or left open there."""
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    headers = F.array(F.when(kind == 0, "Invoice number").otherwise(""), F.lit("Due date"), F.lit("Date"), F.lit("Amount"), F.lit("Currency"))
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("o_orderkey") % 1000).cast("int")), "yyyy-MM-dd")
    amount = F.concat(F.lit("€ "), (F.col("o_orderkey") % 100).cast("string"), F.lit(".5"))
    cells = F.array(F.concat(F.lit("INV-"), key), F.lit("2024-01-01"), day, amount, F.lit("usd"))
    row = F.concat(F.lit("Row AB-1000"), key, F.when(kind == 2, F.concat(F.lit(" and XY-2000"), key)).otherwise(""), F.lit(" x"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", controls.row_claim(headers, cells, row).alias("claim"))


_CLAIMS = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'INV-' || o_orderkey WHEN 1 THEN 'AB-1000' || o_orderkey END AS number,
  strftime(DATE '2020-01-01' + (o_orderkey % 1000)::INT, '%Y-%m-%d') AS issued, (o_orderkey % 100) || '.5' AS total, 'EUR' AS currency FROM orders"""


@query(_CLAIMS)
def row_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("o_orderkey", "claim.*")


@query(f"""SELECT o_orderkey, substr(sha256(CASE WHEN o_orderkey % 4 = 0 THEN 'data-invoice-id=9' WHEN number IS NOT NULL THEN 'invoice=' || number
  ELSE 'date=' || issued || chr(1) || 'total=' || total || chr(1) || 'currency=' || currency END), 1, 32) AS id FROM ({_CLAIMS})""")
def action_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    attribute = F.when(F.col("o_orderkey") % 4 == 0, "data-invoice-id=9").when(F.col("o_orderkey") % 4 == 1, "data-row-id=token7")
    return _claims(spark, sf_dir).select("o_orderkey", controls.action_identity(attribute, F.col("claim")).alias("id"))


@query("""
WITH c AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'https://e.com/' || event_id END AS url, CASE
    WHEN event_id % 3 > 0 THEN event_type || (event_id % 40) END AS action FROM events),
g AS (SELECT user_id, CASE WHEN url IS NULL THEN action END AS a, count(*) AS n, count(url) AS d FROM c GROUP BY 1, 2),
t AS (SELECT user_id, sum(n) AS observed, sum(d) AS direct, count(*) FILTER (a IS NOT NULL AND n = 1) AS stable,
    coalesce(sum(n - d) FILTER (a IS NULL), 0) AS unstable, coalesce(sum(n) FILTER (a IS NOT NULL AND n > 1), 0) AS ambiguous FROM g GROUP BY 1)
SELECT user_id, observed::BIGINT AS observed, direct::BIGINT AS direct, least(stable, 12) AS actions, (direct + least(stable,
    12))::BIGINT AS resolved, (observed - direct - least(stable, 12))::BIGINT AS unresolved,
  unstable::BIGINT AS unstable, ambiguous::BIGINT AS ambiguous, stable > 12 AS truncated FROM t""")
def action_enumerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("event_type") == "click", F.concat(F.lit("https://e.com/"), F.col("event_id").cast("string")))
    action = F.when(F.col("event_id") % 3 > 0, F.concat("event_type", (F.col("event_id") % 40).cast("string")))
    return actions.enumeration(table(spark, sf_dir, "events").select("user_id", url.alias("url"), action.alias("action")), ["user_id"])


@query("""
WITH f AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS k FROM f)
SELECT user_id, string_agg('{"kind":"' || event_type || '"}', ' ' ORDER BY k) AS evidence FROM r WHERE k <= 3 GROUP BY 1""")
def evidence_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = actions.merged_evidence(table(spark, sf_dir, "events"), ["user_id"], F.struct(F.col("event_type").alias("kind")), "event_id", 3)
    return merged.select("user_id", F.array_join("evidence", " ").alias("evidence"))


RESOURCES = ["/invoice", "/billing/plan", "/x", "/receipt/charge", "/plan"]


@query(f"""
WITH c AS (SELECT user_id, event_id, {_list(RESOURCES, 'event_id')} || '/' || (event_id % 7) AS url FROM events),
f AS (SELECT user_id, url, min(event_id) AS event_id FROM c GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN url LIKE '/invoice%' THEN 100 WHEN url LIKE '/billing%' THEN 75 WHEN url LIKE '/receipt%' THEN 150
    WHEN url LIKE '/plan%' THEN 25 ELSE 0 END AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, url COLLATE en, url) AS rank FROM s)
SELECT user_id, event_id, url, score, rank::INT AS rank FROM r WHERE rank <= 12""")
def resource_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(_pick(RESOURCES, "event_id"), F.lit("/"), (F.col("event_id") % 7).cast("string"))
    seen = table(spark, sf_dir, "events").select(
        "user_id", "event_id", url.alias("url"), F.col("props").alias("body"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("sent"),
    )
    return actions.ranked_resources(seen, ["user_id"], "method", "url", "body", "sent", "event_id").select("user_id", "event_id", "url", "score", "rank")


PROBES = ["https://e.com/api/me", "https://e.com/users/me?x=1", "https://f.com/session", "https://e.com/menu", "https://e.com/Account/7"]


@query(f"""SELECT user_id, arg_min({_list(PROBES, 'event_id')}, event_id) AS probe FROM events
WHERE event_id % 3 = 1 AND event_type <> 'error' AND event_id % 5 IN (0, 1, 4) GROUP BY 1""")
def auth_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("event_id")
    method, status = F.when(id % 3 == 1, "GET").otherwise("POST"), F.when(F.col("event_type") != "error", 200).otherwise(401)
    seen = table(spark, sf_dir, "events").select(
        "user_id", "event_id", _pick(PROBES, "event_id").alias("url"), method.alias("method"), status.alias("status"),
        F.lit("https://e.com").alias("origin"),
    )
    return actions.auth_probe(seen, ["user_id"], "origin", "method", "status", "url", "event_id")


@query("""SELECT 'n' || n_nationkey AS id, n_name AS name, 'official' AS kind, n_nationkey::BIGINT AS place FROM nation
    WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)
UNION ALL SELECT 's' || s_suppkey, s_name, 'discovered', NULL FROM supplier""")
def source_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    named = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string")).alias("id")
    recipes = nation.select(named("n", "n_nationkey"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("place"))
    profiles = supplier.select(named("s", "s_suppkey"), F.col("s_name").alias("name"))
    return actions.source_catalog(recipes, profiles, supplier.where("s_suppkey % 3 = 0").select(named("n", "s_nationkey")), "id", "name")


@query("""
WITH n AS (SELECT DISTINCT s_nationkey AS k, 'https://s' || (s_suppkey % 7) || '.com' AS origin, s_suppkey % 5 AS provider FROM supplier),
j AS (SELECT n_nationkey AS k, origin, coalesce(provider = n_regionkey, FALSE) OR n_nationkey % 4 = 0 AS fits FROM nation LEFT JOIN n ON n.k = n_nationkey)
SELECT k, array_to_string(list_sort(list_distinct(list_append(coalesce(list(origin) FILTER (fits AND origin IS NOT NULL),
    []), 'https://a.com'))), ' ') AS origins,
  coalesce(string_agg(DISTINCT origin, ' ' ORDER BY origin) FILTER (NOT fits AND origin IS NOT NULL), '') AS unmatched FROM j GROUP BY 1""")
def document_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"), F.array(F.lit("https://a.com")).alias("origins"), F.col("n_regionkey").cast("long").alias("provider"),
        (F.col("n_nationkey") % 4 == 0).alias("semantic"),
    )
    origin = F.concat(F.lit("https://s"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".com"))
    needed = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("k"), origin.alias("origin"), (F.col("s_suppkey") % 5).cast("long").alias("provider"),
    )
    found = actions.extended_origins(profiles, needed, "k", "origins", "provider", "semantic")
    return found.select("k", F.array_join("origins", " ").alias("origins"), F.array_join("unmatched", " ").alias("unmatched"))


# States of a search

FOUND = ["dom-links", "network-json,dom-links", "", "dom-actions", "embedded-json"]


@query(
    f"SELECT event_id, CASE event_id % 5 WHEN 1 THEN TRUE WHEN 4 THEN TRUE WHEN 2 THEN FALSE WHEN 0 THEN event_id % 2 = 0 ELSE event_id % 2 = 0 AND event_id % 3 >= 1 END AS enough, event_id % 7 > 0 AND event_id % 2 = 0 AS strong FROM events"
)
def proof_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("event_id")
    adapters = F.filter(F.split(_pick(FOUND, "event_id"), ","), lambda a: a != "")
    scores = F.when(id % 7 > 0, F.array(F.lit(200), F.lit(210), F.when(id % 2 == 0, 400).otherwise(199))).otherwise(F.array(F.lit(300)))
    return table(spark, sf_dir, "events").select(
        "event_id", exploration.proof_suffices(adapters, id % 2 == 0, id % 3).alias("enough"), exploration.enough_strong(scores).alias("strong"),
    )


MODES = ["fast", "deep", "self_heal", "other"]


@query(f"""
WITH i AS (SELECT event_id, {_list(MODES, 'event_id')} AS mode, event_id % 100 - 5 AS p, event_id % 50 AS l, event_id % 30 AS c,
    (event_id % 30) * 10000 AS e, event_id % 8 AS s FROM events),
a AS (SELECT *, greatest(0, least(p, CASE mode WHEN 'fast' THEN 40 WHEN 'deep' THEN 60 ELSE 80 END)) AS pages, greatest(0, least(e, CASE mode
    WHEN 'fast' THEN 60000 WHEN 'deep' THEN 120000 ELSE 180000 END)) AS elapsed_ms,
  greatest(0, least(s, CASE mode WHEN 'self_heal' THEN 5 ELSE 1 END)) AS slices FROM i WHERE mode <> 'other'),
b AS (SELECT *, least(l, pages) AS linked, least(c, pages - least(l, pages)) AS common FROM a)
SELECT event_id, pages, linked, common, elapsed_ms, slices, pages = p AND linked = l AND common = c AND elapsed_ms = e AND slices = s AS valid FROM b""")
def exploration_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("event_id")
    held = exploration.checkpoint(_pick(MODES, "event_id"), id % 100 - 5, id % 50, id % 30, (id % 30) * 10000, id % 8)
    return table(spark, sf_dir, "events").select("event_id", held.alias("c")).where("c IS NOT NULL").select("event_id", "c.*")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 > 0 AND event_id % 5 <> 2 THEN 'deep' END AS mode,
  (CASE WHEN event_id % 3 > 0 AND event_id % 5 <> 2 THEN 1 ELSE 0 END)::INT AS left FROM events""")
def frontier_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, nothing = F.col("event_id"), F.lit(None).cast("string")
    target = lambda route, source, hint: F.struct(F.lit("k").alias("key"), route.alias("route"), source.alias("source"), hint.alias("hint"))
    one = target(F.when(id % 3 > 0, "/billing"), F.when(id % 5 == 2, "common_route").otherwise("link"), nothing)
    frontier = F.array(one, target(F.lit("/x"), F.lit("link"), F.lit("common_fallback")), target(F.lit("/y"), nothing, nothing))
    return table(spark, sf_dir, "events").select(
        "event_id", exploration.continued_mode(_pick(MODES, "event_id"), frontier).alias("mode"),
        F.size(exploration.resumable(frontier)).alias("left"),
    )


STAGES, MOVES = ["scanning", "preview", "confirming", "complete", "failed", "awaiting_permission"], [
    "begin", "scan", "preview", "connect", "restore", "complete", "fail", "continue", "clear", "checkpoint", "other",
]
_OPEN = [
    (
        "scan", "awaiting_permission", "scanning",
    ), ("scan", "scanning", "scanning"), ("checkpoint", "scanning", "scanning"), ("preview", "scanning", "preview"), ("connect", "preview", "confirming"),
    ("restore", "confirming", "preview"), ("complete", "confirming", "complete"), ("fail", "scanning", "failed"), ("fail", "confirming", "failed"), ("continue", "failed", "scanning"),
]


@query(f"""
WITH i AS (SELECT event_id, {_list(STAGES, 'event_id')} AS stage, {_list(MOVES, 'event_id')} AS move,
    epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts) AS age FROM events),
m(move, stage, target) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in _OPEN)})
SELECT i.event_id, CASE WHEN age > (CASE i.stage WHEN 'complete' THEN 45 WHEN 'failed' THEN 86400 ELSE 900 END) * 1000000::BIGINT THEN 'idle'
    ELSE i.stage END AS now,
  CASE WHEN i.move = 'begin' THEN 'awaiting_permission' WHEN i.move = 'clear' THEN 'idle' WHEN m.move IN ('scan') OR (m.move = 'continue'
      AND event_id % 2 = 0) OR (m.move <> 'continue' AND event_id % 5 > 0) THEN m.target END AS after
FROM i LEFT JOIN m ON m.move = i.move AND m.stage = i.stage""")
def search_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, id = _pick(STAGES, "event_id"), F.col("event_id")
    now = exploration.state_at(stage, F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", now.alias("now"), exploration.moved(stage, _pick(MOVES, "event_id"), id % 5 > 0, id % 2 == 0).alias("after"),
    )


@query("""
WITH i AS (SELECT event_id, event_id % 5 = 0 AS off, CASE WHEN event_id % 3 > 0 THEN ts + to_minutes(event_id % 7 - 3) END AS next_at, CASE
    WHEN event_id % 4 < 2 THEN ts + to_minutes(event_id % 11 - 5) END AS lease,
  event_id % 2 = 0 AS whole, event_id % 13 = 0 AS retry, ts FROM events),
d AS (SELECT *, coalesce(lease <= ts, FALSE) AS expired FROM i),
w AS (SELECT *, (expired AND whole) OR next_at IS NULL OR next_at <= ts AS due, lease IS NOT NULL AND NOT expired AS held FROM d),
c AS (SELECT *, NOT off AND NOT held AND (due OR retry) AS claimed FROM w)
SELECT event_id, claimed, claimed AND due AS full, CASE WHEN claimed THEN ts + INTERVAL 10 MINUTE WHEN held AND NOT off THEN lease END AS lease_until FROM c""")
def schedule_wakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("event_id")
    after = lambda minutes: F.col("ts") + F.make_dt_interval(mins=minutes.cast("int"))
    done = exploration.wake(id % 5 == 0, F.when(id % 3 > 0, after(id % 7 - 3)), F.when(id % 4 < 2, after(id % 11 - 5)), id % 2 == 0, id % 13 == 0, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", done.alias("w")).select("event_id", "w.*")


STORED = [
    ("filesystem", " Bills/2024 ", "invoice", None, None, None, "filesystem"), (
        "filesystem", "..", "invoice", None, None, None, "unavailable:invalid_stored_destination",
    ),
    (
        "filesystem", "a", "never", None, None, None, "unavailable:invalid_stored_destination",
    ), ("company", None, None, "c1", "Acme", None, "company"), ("company", None, None, "c1", " ", None, "unavailable:invalid_stored_destination"),
    (
        "unavailable", None, None, None, None, "connection_expired", "unavailable:connection_expired",
    ), ("ftp", None, None, None, None, None, "unavailable:invalid_stored_destination"),
]


def _nullable(samples: list, id: str) -> Column:
    return F.element_at(F.array(*[F.lit(s).cast("string") for s in samples]), (F.col(id) % len(samples) + 1).cast("int"))


@query(f"SELECT event_id, {_case(STORED, [s[6] for s in STORED], 'event_id')} AS state FROM events")
def destination_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_nullable([s[i] for s in STORED], "event_id") for i in range(6)]
    return table(spark, sf_dir, "events").select("event_id", exploration.destination_state(*parts).alias("state"))


# Walks over bodies and pages


def _with_key(template: str, key: str) -> Column:
    """A text with `%` for a row's key."""
    return F.replace(F.lit(template), F.lit("%"), F.col(key).cast("string"))


NESTED = '{"data":{"items":[{"invoice_pdf":"/i/%.pdf","note":"x"},{"invoicePdf":"/j"}],"download_url":"/d/%"},"pdf-url":"/p","pdfurl":"/q","curl":"/r"}'


@query("""
WITH s AS (SELECT unnest([0, 1, 3, 4, 6]) AS place,
    unnest(['.pdf-url', '.pdfurl', '.data.download_url', '.data.items.invoice_pdf', '.data.items.invoicePdf']) AS path,
    unnest(['/p', '/q', '/d/%', '/i/%.pdf', '/j']) AS text)
SELECT o_orderkey, place, path, replace(text, '%', o_orderkey::VARCHAR) AS text FROM orders, s""")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.document_fields(table(spark, sf_dir, "orders").select("o_orderkey", _with_key(NESTED, "o_orderkey").alias("body")), "body")


DATA_PAGE = (
    '<script type="application/ld+json">{"@type":"Invoice","x":"https://e.com/billing/%","y":"/billing/%"}</script><p>'
    '<script id=a type="application/json">{"a":{"href":"/account/%?page=2"},"b":"/nope","url":"https://e.com/logout"}</script><script>{"url":"/not/data"}</script>'
)


@query("""
WITH s AS (SELECT unnest([0, 1, 2]) AS place, unnest(['https://e.com/Invoice', 'https://e.com/billing/%', 'https://e.com/account/%?page=2']) AS route)
SELECT c_custkey, replace(route, '%', c_custkey::VARCHAR) AS route, place FROM customer, s""")
def structured_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", _with_key(DATA_PAGE, "c_custkey").alias("html"), F.lit("https://e.com/home").alias("base"))
    return walks.structured_routes(pages, ["c_custkey"], "html", "base")


_SITES = """
WITH p AS (SELECT page_id, page_id % 50 AS site,
    html || '<a href="/invoice/' || (page_id % 120) || '">' || '<a href="/files/' || page_id || '.pdf">' AS html FROM pages WHERE html IS NOT NULL),
l AS (SELECT site, page_id, unnest(regexp_extract_all(html, '(?i)\\bhref="([^"]+)"', 1)) AS link,
    generate_subscripts(regexp_extract_all(html, '(?i)\\bhref="([^"]+)"', 1), 1) AS pos FROM p)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two links to documents more, dealt over 50 sites."""
    more = F.concat(
        "html", F.lit('<a href="/invoice/'), (F.col("page_id") % 120).cast("string"), F.lit('"><a href="/files/'), F.col("page_id").cast("string"),
        F.lit('.pdf">'),
    )
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", (F.col("page_id") % 50).alias("site"), more.alias("html"))


@query(_SITES + """,
f AS (SELECT site, link, min((page_id, pos)) AS first_at FROM l WHERE regexp_matches(link, '(?i)receipt|invoice|\\.pdf(\\?|$)|/download') GROUP BY 1, 2),
r AS (SELECT site, link, row_number() OVER (PARTITION BY site ORDER BY first_at) - 1 AS place FROM f)
SELECT site, link, place::INT AS place FROM r WHERE place < 20""")
def document_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.document_hints(_sites(spark, sf_dir), ["site"], "html", "page_id")


@query(_SITES + """,
t AS (SELECT site, token, learned, min(t) AS t FROM (SELECT site, '/files/' AS token, TRUE AS learned, page_id AS t FROM p WHERE site % 3 = 0
  UNION ALL SELECT site, unnest(['receipt', 'invoice', 'billing', 'download', '.pdf']), FALSE, unnest([0, 1, 2, 3, 4]) FROM p) GROUP BY 1, 2, 3),
c AS (SELECT l.site, page_id AS page, token, learned, t, count(DISTINCT link) AS n_links FROM l JOIN t ON t.site = l.site AND contains(link, token)
    GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY NOT learned, n_links DESC, page, t) AS k FROM c)
SELECT site, page, token, learned, n_links FROM r WHERE k = 1""")
def link_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _sites(spark, sf_dir)
    pdfs = pages.where("site % 3 = 0").select(
        "site", "page_id", F.concat(F.lit("https://e.com/files/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("url"),
    )
    return walks.best_link_token(pages, pdfs, ["site"], "html", "page_id")


PEOPLE = (
    '{"id":%,"customerName":"Anna %","note":"write to a!b.se or abcdefghijklmnopqrstuvwx% then abcdefghijklmnopqrstuvwx%","total":12.5,'
    '"items":[{"url":"https://e.com/aaaaaaaaaaaaaaaaaaaaaaaaaaaa%/x","card":"4111"},{"pay":"4111 1111 1111 1111"},{"pay":"4111 1111 1111 1112"},{"to":"GB82 WEST 1234 5698 7654 32"}],"a!b.se":"x","ok":null}'
)
NO_PEOPLE = (
    '{"id":%,"customerName":"REDACTED","note":"write to user!example.com or REDACTED_VALUE_1 then REDACTED_VALUE_1","total":12.5,'
    '"items":[{"url":"https://e.com/REDACTED_VALUE_2/x","card":"REDACTED"},{"pay":"REDACTED"},{"pay":"4111 1111 1111 1112"},{"to":"REDACTED"}],"__redacted_key_1__":"x","ok":null}'
)


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN replace(replace('{NO_PEOPLE}', '%', c_custkey::VARCHAR), '!', '@') END AS body FROM customer")
def redacted_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with people, payments and tokens; each ninth is no JSON."""
    body = F.replace(_with_key(PEOPLE, "c_custkey"), F.lit("!"), F.lit("@"))
    return walks.fixture(
        spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, body).otherwise("{oops").alias("body")), "body",
    )


SECRETS = '{"access_token":"t","data":{"accessToken":"u","customer":{"id":%}},"list":[{"v":"Bearer abcdefghij"},{"v":"plain"}],"iban":["x"],"a b":{"otp":1}}'
NO_SECRETS = '{"access_token":"REDACTED","data":{"accessToken":"REDACTED","customer":{"id":%}},"list":[{"v":"REDACTED"},{"v":"plain"}],"iban":"REDACTED","a b":{"otp":"REDACTED"}}'


@query(f"SELECT c_custkey, replace('{NO_SECRETS}', '%', c_custkey::VARCHAR) AS value, 'access_token,data.accessToken,list.0.v,iban' AS paths FROM customer")
def evidence_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = walks.evidence(spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", _with_key(SECRETS, "c_custkey").alias("body")), "body")
    return found.select("c_custkey", F.col("body.value").alias("value"), F.array_join("body.paths", ",").alias("paths"))
