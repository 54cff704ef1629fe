"""Registered queries of policy, journal, lifecycle and view rules, each with its SQL for DuckDB.

Inputs that the tables lack (addresses, headers, amounts as shown) are picked from a list by a row's id, alike in both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import policy, urls, values
from .operators import identity, inference, outcomes, ranking, retrieval, views
from .queries import _HOST, _bodies, query, table
from .sources import scans


def _pick(samples: Sequence[str], id: str) -> Column:
    return F.element_at(F.array(*map(F.lit, samples)), (F.col(id) % len(samples) + 1).cast("int"))


def _list(samples: Sequence[str], id: str) -> str:
    return "([" + ", ".join("'" + s.replace("'", "''") + "'" for s in samples) + f"])[{id} % {len(samples)} + 1]"


def _case(samples: Sequence[str], answers: Sequence, id: str) -> str:
    """The known answer to each sample, picked by the same id: what the rule has to say, written out."""
    told = [
        "NULL" if a is None else str(a).lower() if isinstance(a, bool) else str(a) if isinstance(a, int) else "'" + a.replace("'", "''") + "'" for a in answers
    ]
    return f"CASE {id} % {len(samples)} " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(told)) + " END"


@query(
    "SELECT o_orderkey, sha256(o_custkey::VARCHAR || chr(0) || 'orders' || chr(0) || 'pdf-content' || chr(0) || sha256(o_comment)) AS key FROM (SELECT o_orderkey, o_custkey, o_orderpriority AS o_comment FROM orders)"
)
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = values.content_key(F.col("o_custkey").cast("string"), F.lit("orders"), F.col("o_orderpriority").cast("binary"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))


@query("""
WITH u AS (SELECT page_id, url FROM pages WHERE url IS NOT NULL),
h(page_id, url, i, v) AS (SELECT page_id, url, 0, 2166136261::BIGINT FROM u),
f AS (SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: ord(c)::BIGINT)), lambda a,
    b: (xor(a, b) * 16777619) & 4294967295) AS v FROM u)
SELECT page_id, lpad(array_to_string(list_transform(range(6, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz',
    ((v // (36 ** k)::BIGINT) % 36)::INT + 1, 1)), ''), 7, '0') AS id FROM f""")
def origin_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", values.origin_id(F.col("url")).alias("id"))


PATHS = ["/billing/invoice", "/settings/history", "/account/payment", "/x", "/Receipts"]


@query(f"SELECT event_id, {_case(PATHS, [33, 10, 7, 0, 18], 'event_id')}::INT AS score FROM events")
def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", urls.path_score(_pick(PATHS, "event_id")).cast("int").alias("score"))


@query(
    "SELECT o_orderkey, 'root/' || regexp_replace(o_orderpriority, '[:/]', '-', 'g') || '/' || CASE WHEN o_orderkey % 5 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END || '/o-' || o_orderkey || '.pdf' AS path FROM orders"
)
def save_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = values.save_path(F.lit("root"), F.col("o_orderpriority"), day, F.concat(F.lit("o:"), F.col("o_orderkey"), F.lit(".pdf")))
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))


@query("SELECT c_custkey, '[[\"nation\",\"' || c_nationkey || '\"],[\"segment\",\"' || c_mktsegment || '\"]]' || chr(0) || c_custkey AS id FROM customer")
def scoped_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = identity.scoped_identity([("nation", F.col("c_nationkey")), ("segment", F.col("c_mktsegment"))], F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", id.alias("id"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'time_cap' WHEN event_type = 'signup' OR user_id % 20 >= 12 THEN 'action_cap' WHEN value * 1000 >= 60000 THEN 'time_cap' WHEN event_id % 700 >= 500 THEN 'document_cap' END AS cause FROM events"""
)
def continuation_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    cause = policy.continuation_end(kind == "error", kind == "signup", F.col("user_id") % 20, F.col("value") * 1000, F.col("event_id") % 700, (12, 60_000, 500))
    return table(spark, sf_dir, "events").select("event_id", cause.alias("cause"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS from_year, strftime(o_orderdate, '%m') AS from_month, strftime(date_trunc('month',
    o_orderdate), '%Y-%m-%d') AS from_date, epoch_ms(date_trunc('month', o_orderdate)::TIMESTAMP)::BIGINT AS from_ms,
  strftime(last_day(o_orderdate), '%Y-%m-%d') AS through_date, strftime(last_day(o_orderdate) + 1, '%Y-%m-%d') AS to_exclusive_date,
      epoch_ms((last_day(o_orderdate) + 1)::TIMESTAMP)::BIGINT AS to_exclusive_ms FROM orders""")
def month_window_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").select("o_orderkey", *policy.month_bounds(month, month))


_HEALTH = ["healthy", "needs_verification", "verification_stale", "security_hold", "retired"]
_STAGES = ["pilot", "supported", "degraded", "experimental", "retired", "supported", "supported"]


@query(f"""
WITH e AS (SELECT o_orderkey, {_list(_STAGES, 'o_orderkey')} AS stage, {_list(_HEALTH, 'o_orderkey')} AS health, CASE
    WHEN o_orderkey % 11 <> 0 THEN o_orderdate::TIMESTAMP END AS v FROM orders),
f AS (SELECT *, coalesce(v <= TIMESTAMP '1998-06-15' AND v >= TIMESTAMP '1998-06-15' - INTERVAL 90 DAY, false) AS fresh,
    health IN ('healthy', 'needs_verification', 'verification_stale') AS runs FROM e)
SELECT o_orderkey, fresh, CASE WHEN stage = 'pilot' THEN runs ELSE stage = 'supported' AND health = 'healthy' AND v IS NOT NULL AND fresh END AS runnable,
  CASE WHEN stage = 'retired' THEN 'Retired' WHEN stage = 'experimental' THEN 'Experimental'
      WHEN stage = 'degraded' THEN 'Degraded: ' || replace(health, '_', ' ') WHEN stage = 'pilot'
      AND NOT runs THEN 'Pilot: ' || replace(health, '_', ' ')
    WHEN stage = 'pilot' AND health = 'healthy' AND fresh THEN 'Pilot: live verified' WHEN stage = 'pilot' THEN 'Pilot: bundled recipe'
        WHEN v IS NULL THEN 'Supported: verification needed' WHEN NOT fresh THEN 'Supported: verification stale'
        ELSE 'Supported: live verified' END AS label FROM f""")
def lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp"))
    now = F.lit("1998-06-15").cast("timestamp")
    stage, health = _pick(_STAGES, "o_orderkey"), _pick(_HEALTH, "o_orderkey")
    fresh = views.is_fresh(verified, F.lit("1999-01-01").cast("timestamp"), now)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fresh.alias("fresh"), views.is_runnable(stage, health, verified.isNotNull(), fresh).alias("runnable"),
        views.lifecycle_label(stage, health, verified, fresh).alias("label"),
    )


_RUN = "CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'partial' WHEN 'purchase' THEN 'rate_limited' WHEN 'signup' THEN 'auth_expired' ELSE 'error' END"


@query(f"""
WITH r AS (SELECT user_id, event_id, {_RUN} AS s, CASE WHEN value > 90 THEN 1 ELSE 0 END AS n FROM events),
g AS (SELECT user_id, sum(CASE WHEN s IN ('ok', 'partial') THEN n ELSE 0 END)::BIGINT AS collected,
    count(*) FILTER (s NOT IN ('ok', 'partial')) AS attention, min(event_id) FILTER (s = 'rate_limited') AS w,
    min(event_id) FILTER (s = 'auth_expired') AS x, min(event_id) FILTER (s = 'error') AS f, min(event_id) FILTER (s = 'partial') AS p FROM r
    GROUP BY 1)
SELECT user_id, collected, attention, CASE WHEN collected > 0 THEN 'collected' WHEN w IS NOT NULL THEN 'waiting' WHEN x IS NOT NULL THEN 'expired'
    WHEN f IS NOT NULL THEN 'failed' WHEN p IS NOT NULL THEN 'partial' ELSE 'none' END AS kind,
  CASE WHEN collected > 0 THEN NULL ELSE coalesce(w, x, f, p) END AS first FROM g""")
def run_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_RUN).alias("s"), F.when(F.col("value") > 90, 1).otherwise(0).alias("n"))
    return views.run_rollup(runs, ["user_id"], "event_id", "s", "n").withColumn("collected", F.col("collected").cast("long"))


@query(f"""
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, {_RUN} AS s, CASE WHEN value > 50 THEN 'document_invalid'
    WHEN value > 20 THEN 'schema_down' END AS c, CASE WHEN value > 80 THEN 1 ELSE 0 END AS n FROM events),
k AS (SELECT *, CASE WHEN s IN ('ok', 'partial') AND n > 0 AND coalesce(c, '') <> 'retrieval_incomplete' THEN 'success'
    WHEN s IN ('auth_expired', 'rate_limited', 'skipped') OR
    coalesce(c, 'unknown') NOT IN ({", ".join(f"'{c}'" for c in views.LOCAL_CODES)}) THEN 'fatal' END AS kind FROM r)
SELECT user_id, coalesce(arg_min(kind, p) FILTER (kind IS NOT NULL), 'exhausted') AS kind, coalesce(min(p) FILTER (kind IS NOT NULL),
    count(*)) AS attempted FROM k GROUP BY 1""")
def first_working_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(
        "user_id", place.alias("p"), F.expr(_RUN).alias("s"),
        F.expr("CASE WHEN value > 50 THEN 'document_invalid' WHEN value > 20 THEN 'schema_down' END").alias("c"),
        F.when(F.col("value") > 80, 1).otherwise(0).alias("n"),
    )
    return views.first_working(rows, ["user_id"], "p", F.col("s"), F.col("c"), F.col("n"))


@query("""
WITH RECURSIVE h AS (SELECT l_orderkey, l_partkey AS k, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_orderkey, k, ['s' || k % 5, 's' || k % 7, 't' || k % 3] AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, k) AS i FROM h),
s(l_orderkey, i, n, kept, place, o) AS (
  SELECT DISTINCT l_orderkey, 0::BIGINT, 0::BIGINT, NULL::INTEGER, NULL::BIGINT, []::VARCHAR[] FROM c
  UNION ALL
  SELECT s.l_orderkey, c.i, CASE WHEN ok THEN s.n + 1 ELSE s.n END, CASE WHEN ok THEN c.k END, CASE WHEN ok THEN s.n END, CASE
      WHEN ok THEN list_distinct(list_concat(s.o, c.o)) ELSE s.o END
  FROM s JOIN c ON c.l_orderkey = s.l_orderkey AND c.i = s.i + 1, LATERAL (SELECT s.n < 3 AND len(list_distinct(list_concat(s.o, c.o))) <= 6 AS ok) t)
SELECT l_orderkey, kept::VARCHAR AS l_partkey, place FROM s WHERE kept IS NOT NULL""")
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.array(name("s", 5), name("s", 7), name("t", 3)).alias("o"))
    found = views.candidate_set(rows.withColumn("k2", k), ["l_orderkey"], ["l_linenumber", "k2"], "l_partkey", "o", most_origins=6)
    return found.withColumn("place", F.col("place").cast("long"))


_FAMILY = "(['exact_entry', 'observed_navigation', 'embedded_data', 'semantic_download', 'elsewhere'])[event_id % 5 + 1]"


@query(f"""
WITH a AS (SELECT user_id, bool_and(value < 95) AS done, list_sort(list_distinct(list({_FAMILY}) FILTER (event_id % 5 < 4))) AS m FROM events GROUP BY 1)
SELECT user_id, array_to_string(coalesce(m, []), ',') AS attempted, CASE WHEN done THEN array_to_string(coalesce(m, []), ',') ELSE '' END AS exhausted,
  CASE WHEN done THEN array_to_string(list_sort(list_filter([{", ".join(f"'{f}'" for f in views.FAMILIES)}], lambda f: NOT list_contains(coalesce(m,
      []), f))), ',') ELSE '' END AS unavailable FROM a""")
def family_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = _pick(["exact_entry", "observed_navigation", "embedded_data", "semantic_download", "elsewhere"], "event_id")
    return views.family_coverage(table(spark, sf_dir, "events").withColumn("family", family), ["user_id"], "family", F.col("value") < 95)


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS succeeded, count(*) FILTER (event_type = 'click') AS empty,
    count(*) FILTER (event_type NOT IN ('view', 'click')) AS failed,
  coalesce(string_agg(DISTINCT CASE WHEN event_type NOT IN ('view', 'click') THEN event_type END, ',' ORDER BY CASE
      WHEN event_type NOT IN ('view', 'click') THEN event_type END), '') AS codes FROM events GROUP BY 1""")
def scope_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").withColumn("s", F.when(kind == "view", "succeeded").when(kind == "click", "empty").otherwise("failed"))
    return views.scope_summary(rows, ["user_id"], "s", "event_type")


@query(
    """SELECT c_nationkey, count(*) FILTER (c_acctbal > 0 AND c_acctbal <= 3000) AS due, min(c_acctbal) FILTER (c_acctbal > 3000 AND c_acctbal <= 5000) AS next FROM customer GROUP BY 1"""
)
def retry_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.retry_snapshot(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", F.lit(3000), F.lit(2000))


@query("SELECT o_custkey, bool_or(DATE '1998-06-15' - o_orderdate::DATE >= 2300) AS due FROM orders GROUP BY 1")
def catch_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ago = F.datediff(F.lit("1998-06-15").cast("date"), F.col("o_orderdate").cast("date"))
    return views.catch_up_due(table(spark, sf_dir, "orders").withColumn("ago", -ago), ["o_custkey"], F.col("ago"), F.lit(0), F.lit(2300))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 9 AS k, (value * 3000)::BIGINT AS z, row_number() OVER (PARTITION BY user_id
    ORDER BY event_id) AS i FROM events WHERE (value * 3000)::BIGINT <= 768000),
s(user_id, i, held) AS (
  SELECT DISTINCT user_id, 0::BIGINT, []::STRUCT(p BIGINT, k BIGINT, z BIGINT)[] FROM e
  UNION ALL
  SELECT s.user_id, e.i, list_append(list_filter(o, lambda x, n: n > len(o) - 11 AND list_sum(list_transform(o[n:],
      lambda y: y.z)) + e.z <= 768000), {'p': e.event_id, 'k': e.k, 'z': e.z})
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1, LATERAL (SELECT list_filter(s.held, lambda x: x.k <> e.k) AS o) t)
SELECT user_id, unnest(held).p AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM s) WHERE r = 1""")
def capture_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("event_id") % 9).alias("request"), F.round(F.col("value") * 3000).cast("long").alias("size"),
    )
    return views.capture_buffer(rows, ["user_id"], "event_id", "request", "size")


@query("SELECT s_nationkey, count(*) AS n, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY 1")
def destination_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.suppliers_by_destination(table(spark, sf_dir, "supplier"), "s_nationkey", "s_name")


#: Even events as a journal of their users, odd ones as a batch of deliveries; identities, destinations and sources meet in part.
_JOURNAL = """
e AS (SELECT event_id, user_id AS owner, event_id // 2 % 60 AS k, event_id // 2 % 90 AS m FROM events),
j AS (SELECT owner, sha256(owner || '-' || k) AS identity, CASE
    WHEN id % 6 > 0 THEN 'src' || (id % 4) END AS source, 'd' || (k % 3) AS destination, 'p' || id AS path, CASE WHEN id % 8 < 2 THEN 'pending'
    ELSE 'committed' END AS status, id AS updated
  FROM (SELECT owner, k, max(event_id) AS id FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2)),
n AS (SELECT owner, sha256(owner || '-' || m) AS identity, 'src' || (id // 3 % 2 * 2) AS source, 'd' || (id % 3) AS destination, 'n' || id AS path,
    id + 1000000 AS updated
  FROM (SELECT owner, m, min(event_id) AS id FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2))"""
_PREPARED = f"""WITH {_JOURNAL},
m AS (SELECT n.*, CASE WHEN j.destination IS DISTINCT FROM n.destination THEN 'fresh' WHEN coalesce(j.source <> n.source, false) THEN 'supplier'
    ELSE 'again' END AS what, j.path AS old_path, j.status AS old_status, j.updated AS old_updated
  FROM n LEFT JOIN j USING (owner, identity)),
k AS (SELECT j.* FROM j ANTI JOIN (SELECT owner, identity FROM m WHERE what <> 'supplier') USING (owner, identity)),
c AS (SELECT owner, sum(k) + sum(a) + sum(f) - 30 AS over, sum(c) AS committed, sum(f) AS f FROM (
  SELECT owner, count(*) AS k, 0 AS a, 0 AS f, count(*) FILTER (status = 'committed') AS c FROM k GROUP BY 1
  UNION ALL SELECT owner, 0, count(*) FILTER (what = 'again'), count(*) FILTER (what = 'fresh'), 0 FROM m GROUP BY 1) GROUP BY 1),
g AS (SELECT owner, identity FROM (SELECT k.*, row_number() OVER (PARTITION BY owner ORDER BY updated, identity) AS t FROM k
    WHERE status = 'committed') JOIN c USING (owner) WHERE t <= over),
l AS (SELECT owner, identity FROM (SELECT m.*, row_number() OVER (PARTITION BY owner ORDER BY updated DESC, identity DESC) AS t FROM m
    WHERE what = 'fresh') JOIN c USING (owner) WHERE t <= over - committed)
"""


def _journal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    id, text = F.col("id"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"), F.floor(F.col("event_id") / 2).alias("h"))
    of = lambda n: F.sha2(F.concat_ws("-", F.col("owner").cast("string"), F.col(n).cast("string")), 256).alias("identity")
    old = events.where("event_id % 2 = 0").groupBy("owner", (F.col("h") % 60).alias("k")).agg(F.max("event_id").alias("id"))
    new = events.where("event_id % 2 = 1").groupBy("owner", (F.col("h") % 90).alias("k")).agg(F.min("event_id").alias("id"))
    journal = old.select(
        "owner", of("k"), F.when(id % 6 > 0, text("src", id % 4)).alias("source"), text("d", F.col("k") % 3).alias("destination"),
        text("p", id).alias("path"), F.when(id % 8 < 2, "pending").otherwise("committed").alias("status"), id.alias("updated"),
    )
    return journal, new.select(
        "owner", of("k"), text("src", F.floor(id / 3) % 2 * 2).alias("source"), text("d", id % 3).alias("destination"), text("n", id).alias("path"),
        (id + 1000000).alias("updated"),
    )


@query(f"""{_PREPARED}
SELECT owner, identity, source, destination, path, status, updated FROM k ANTI JOIN g USING (owner, identity) ANTI JOIN (SELECT m.owner, m.identity
    FROM m JOIN l USING (owner, identity)) USING (owner, identity)
UNION ALL SELECT owner, identity, source, destination, old_path, old_status, old_updated FROM m WHERE what = 'again'
UNION ALL SELECT owner, identity, source, destination, path, 'pending', updated FROM m ANTI JOIN l USING (owner, identity) WHERE what = 'fresh'
UNION ALL SELECT j.owner, j.identity, j.source, j.destination, j.path, j.status, j.updated FROM j JOIN l USING (owner, identity)""")
def journal_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.prepare_deliveries(*_journal(spark, sf_dir), "owner", cap=30)[0]


@query(f"{_PREPARED} SELECT owner, identity, what AS why FROM m WHERE what = 'supplier' UNION ALL SELECT owner, identity, 'full' FROM l")
def journal_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another supplier's entries, and what finds no room."""
    return views.prepare_deliveries(*_journal(spark, sf_dir), "owner", cap=30)[1]


_DONE = "d AS (SELECT owner, identity, CASE WHEN updated % 10 = 0 THEN 'd9' ELSE destination END AS destination, CASE WHEN updated % 14 = 0 THEN 'moved' ELSE path END AS path, updated + 5 AS updated FROM j WHERE updated % 4 = 0 UNION ALL SELECT owner, 'x' || identity, destination, path, updated FROM j WHERE updated % 22 = 0)"


def _committed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = views.valid_journal(_journal(spark, sf_dir)[0])
    at = F.col("updated")
    done = old.where(at % 4 == 0).select(
        "owner", "identity", F.when(at % 10 == 0, "d9").otherwise(F.col("destination")).alias("destination"),
        F.when(at % 14 == 0, "moved").otherwise(F.col("path")).alias("path"), (at + 5).alias("updated"),
    )
    lost = old.where(at % 22 == 0).select("owner", F.concat(F.lit("x"), "identity").alias("identity"), "destination", "path", "updated")
    return views.commit_deliveries(old, done.unionByName(lost), "owner")


@query(f"""WITH {_JOURNAL}, {_DONE}
SELECT owner, j.identity, j.source, CASE WHEN d.path = j.path AND d.destination = j.destination THEN 'committed' ELSE j.status END AS status, CASE
    WHEN d.path = j.path AND d.destination = j.destination THEN d.updated ELSE j.updated END AS updated
FROM j LEFT JOIN d USING (owner, identity) WHERE j.source IS NOT NULL AND j.source <> 'src2'""")
def journal_commit_and_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clear_journal(_committed(spark, sf_dir)[0], "src2").select("owner", "identity", "source", "status", "updated")


@query(f"""WITH {_JOURNAL}, {_DONE}
SELECT d.owner, d.identity, CASE WHEN j.identity IS NULL THEN 'missing' ELSE 'changed' END AS why FROM d LEFT JOIN j ON j.owner = d.owner
    AND j.identity = d.identity
WHERE j.identity IS NULL OR j.path <> d.path OR j.destination <> d.destination""")
def journal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir)[1]


@query("""
WITH o AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_acctbal > -500 THEN c_acctbal + 1 END AS own FROM customer)
SELECT CASE WHEN count(*) FILTER (own IS NULL) = 0 THEN min(own) END AS covered_until, count(*) FILTER (own IS NULL) AS pending FROM o""")
def coverage_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("complete"), (F.col("c_acctbal") + 1).alias("last"), "c_acctbal",
    )
    return outcomes.watermark(rows, "complete", "last", F.col("c_acctbal") > -500)


@query("SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'auth' WHEN event_type = 'click' THEN 'list' END AS phase FROM events")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = lambda bad: F.when(bad, "failed").otherwise("ok")
    phases = F.array(
        *[
            F.struct(F.lit(p).alias("phase"), state(bad).alias("status")) for p, bad in (
                ("list", kind.isin("click", "error")), ("auth", kind.isin("purchase", "error")),
            )
        ]
    )
    return table(spark, sf_dir, "events").select("event_id", outcomes.first_failure(phases).alias("phase"))


@query(
    "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 8"
)
def slowest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return ranking.top_k(rows, ["user_id"], [F.col("value").desc(), F.col("event_id")], views.SLOWEST).drop("rank")


@query(f"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '\\bhref="([^"]+)"', 1)) AS url FROM pages),
t AS (SELECT page_id, url, CASE WHEN url = '/the' THEN 'remembered' WHEN url LIKE '/and%' THEN 'common_route' ELSE 'link' END AS source, CASE
    WHEN regexp_matches(url, '(?i)^/[a-m]') THEN 'a' ELSE 'b' END AS family FROM l),
s AS (SELECT page_id, url, source, family, max(CASE source WHEN 'remembered' THEN 160 WHEN 'common_route' THEN 100 ELSE 85 END + CASE
    WHEN contains(lower(url), 'in') THEN 5 ELSE 0 END - 1) AS score FROM t GROUP BY ALL),
n AS (SELECT *, CASE source WHEN 'remembered' THEN 0 WHEN 'common_route' THEN 1 ELSE 2 END AS kind, CASE WHEN source = 'link' THEN family
    ELSE '' END AS fam FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind, fam ORDER BY score DESC, url COLLATE en, url) AS turn FROM n),
r AS (SELECT page_id, url, score, row_number() OVER (PARTITION BY page_id ORDER BY kind, turn, fam) AS rank FROM k)
SELECT page_id, url, score::BIGINT AS score, rank FROM r WHERE rank <= 4""")
def frontier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(scans.anchors(F.col("html"))).alias("url"))
    links = links.withColumns(
        {
            "source": F.when(url == "/the", "remembered").when(url.startswith("/and"), "common_route").otherwise("link"),
            "family": F.when(url.rlike("(?i)^/[a-m]"), "a").otherwise("b"),
        }
    )
    found = ranking.planned_targets(links, ["page_id"], "url", "source", "family", F.when(F.lower(url).contains("in"), 5).otherwise(0), F.lit(0), F.lit(1), 4)
    return found.select("page_id", "url", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH v AS (SELECT r_regionkey AS k, n_name AS nation, s AS status, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name, s) - 1 AS place
    FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT unnest(['open', 'paid', 'void']) AS s))
SELECT k, place, nation, status FROM v WHERE place < 7""")
def preview_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.lit("nation").alias("option"), F.col("n_name").alias("value"))
    status = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("k"), F.lit("status").alias("option"), F.explode(F.array(*map(F.lit, ("open", "paid", "void")))).alias("value"),
    )
    found = retrieval.preview_scopes(nations.unionByName(status), ["k"], "option", "value", ["value"], 7)
    return found.select("k", F.col("place").cast("long").alias("place"), F.col("scope")["nation"].alias("nation"), F.col("scope")["status"].alias("status"))


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n, avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END) AS score FROM orders GROUP BY 1)
SELECT o_custkey, 'data.items' AS list, n AS n_items FROM s WHERE score >= 0.5""")
def best_invoice_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = inference.array_scores(inference.leaves(_bodies(spark, sf_dir), "body"), ["o_custkey"])
    return inference.best_array(scores, ["o_custkey"]).select("o_custkey", "list", "n_items")


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN NULL ELSE sha256('%PDF-' || event_id) END AS pdf FROM events"""
)
def inline_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data addresses: a PDF, one with another content, one that is no base64, and a plain address."""
    body = F.concat(F.when(F.col("event_id") % 4 == 2, "GIF8").otherwise("%PDF-"), F.col("event_id").cast("string"))
    data = F.concat(F.lit("data:application/pdf;base64,"), F.base64(body.cast("binary")))
    url = F.when(F.col("event_id") % 4 == 0, "https://a.com/x.pdf").when(F.col("event_id") % 4 == 3, "data:application/pdf;base64,%%%").otherwise(data)
    return table(spark, sf_dir, "events").select("event_id", F.sha2(scans.inline_pdf(url), 256).alias("pdf"))


@query(
    "SELECT event_id, CASE WHEN event_id % 4 >= 2 AND event_type IN ('view', 'click') AND value > 50 THEN 'high' WHEN event_id % 4 >= 1 AND (event_type IN ('view', 'click') OR value > 50) THEN 'medium' ELSE 'low' END AS confidence FROM events"
)
def recipe_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = ranking.confidence(F.col("event_id") % 4, F.col("event_type").isin("view", "click"), F.col("value") > 50)
    return table(spark, sf_dir, "events").select("event_id", label.alias("confidence"))


_LABELS = ["unit_cents", "total", "minor_total", "amount"]


@query("SELECT event_id, event_id % 4 IN (0, 2) OR (event_id % 900) >= 100 AS minor FROM events")
def minor_unit_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", inference.minor_units((F.col("event_id") % 900).cast("string"), _pick(_LABELS, "event_id")).alias("minor"),
    )


@query(f"""
WITH h AS (SELECT page_id, {_HOST} AS host, regexp_extract({_HOST}, '([^.]+)[.][^.]+$', 1) AS domain FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Stable' WHEN page_id % 3 = 1 THEN 'Declared' WHEN domain <> '' THEN domain
    ELSE 'Discovered Supplier' END AS name FROM h""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, domain = F.col("page_id"), F.regexp_extract(urls.host_of(F.col("url")), "([^.]+)[.][^.]+$", 1)
    name = ranking.display_name(F.when(id % 3 == 0, "Stable"), F.when(id % 3 == 1, "Declared"), domain)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
