"""What captured requests and responses tell of each other: how pages follow, where ids come from, which tenant a page is of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy, urls
from ..sources import walks

# Names of what says that more follows, of query keys that ask for it, and shapes of ids.
NEXT_URL, CURSOR = r"^(?:next_url|nextUrl)$", r"^(?:next_page|next_cursor|nextCursor|cursor|endCursor|page_token|nextPageToken)$"
MORE = r"^(?:has_more|hasMore|has_next_page|hasNextPage)$"
CURSOR_QUERY = ("page", "cursor", "offset", "starting_after", "after", "page_token")
OFFSET_SIZES, PAGE_SIZES, OFFSET_SIZE, MOST_SIZE = ("limit", "per_page", "page_size"), ("per_page", "limit", "page_size"), 50, 500
ID = r"^(?:(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})|[0-9]{6,}|[A-Za-z0-9_-]{16,})$"
REFERENCE = r"^ref_[0-9]+$"
ACCOUNT_URL = r"(?i)/(?:me|account|session|organization|user)"
SCOPE_NAME = r"^(?:workspace|organization|org|team|project|tenant|account|customer)s?(?:_?id)?$"
MEMBER_NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,63}$"


def query_pairs(url: Column) -> Column:
    """array<struct<key,value>> of a URL's query, decoded."""
    plain = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), c)
    pairs = F.filter(F.split(urls.query_of(url), "&"), lambda kv: kv != "")
    return F.transform(
        pairs,
        lambda kv: F.struct(plain(F.regexp_extract(kv, "(?s)^([^=]*)", 1)).alias("key"), plain(F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1)).alias("value")),
    )


def _shared(a: Column, b: Column) -> Column:
    """How many parts two dotted paths have in common from the left."""
    left, right = F.split(a, r"\."), F.split(b, r"\.")
    same = F.zip_with(left, right, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def pagination(pages: DataFrame, keys: Sequence[str], url: str, body: str) -> DataFrame:
    """(keys, kind, path, more, step, page_size): how a listing goes on, from the address it was asked for at and its body; no row where nothing says so.

    A next address in the body decides (`next-url`). Else the request's own query does: a `cursor` that the body has and the
    request can take; or a flag that more follows, with the request's offset or page number. A cursor takes the flag that shares
    most of its path, the others the first one. Flags are booleans, numbers or texts. Fields in lists do not count.
    """
    pairs = pages.select(*keys, query_pairs(F.col(url)).alias("_query"), body)
    found = walks.scalars(pairs, body).where("NOT listed AND path <> '$'")
    key, value, text = F.col("key"), F.col("value"), (F.col("kind") == "string") & (F.col("value") != "")
    above = F.regexp_replace(F.col("path"), r"\.?[^.]*$", "")
    is_next = text & value.rlike("^(?:https?://|/)") & (key.rlike(NEXT_URL) | (F.lower(key) == "next") & above.rlike(r"(?i)(?:^|\.)links?$"))
    first = lambda what: F.min_by(F.when(what, F.col("path")), F.when(what, F.col("place")))
    is_flag = key.rlike(MORE) & F.col("kind").isin("boolean", "number", "string")
    by_body = found.groupBy(*keys).agg(
        F.first("_query").alias("_query"), first(is_next).alias("_next"), first(text & key.rlike(CURSOR)).alias("_cursor"),
        F.array_sort(F.collect_list(F.when(is_flag, F.struct("place", "path")))).alias("_flags"),
    )
    asks = lambda *names: F.exists("_query", lambda p: p["key"].isin(*names))
    whole = lambda v: v.try_cast("double")

    def size(names: Sequence[str]) -> Column:
        one = lambda name: F.get(F.filter("_query", lambda p: p["key"] == name), F.lit(0))["value"]
        good = lambda v: F.when((whole(v) == F.floor(whole(v))) & whole(v).between(1, MOST_SIZE), whole(v).cast("int"))
        return F.coalesce(*[good(one(n)) for n in names])

    flag = F.get("_flags", F.lit(0))["path"]
    nearest = F.array_min(F.transform("_flags", lambda f: F.struct((-_shared(F.col("_cursor"), f["path"])).alias("a"), f["place"], f["path"])))["path"]
    kind = (
        F.when(F.col("_next").isNotNull(), "next-url").when(F.col("_cursor").isNotNull() & asks(*CURSOR_QUERY), "cursor")
        .when(F.exists("_query", lambda p: F.lower(p["key"]) == "offset") & flag.isNotNull(), "offset").when(
            F.exists("_query", lambda p: F.lower(p["key"]).isin("page", "p")) & flag.isNotNull(), "page",
        )
    )
    judged = by_body.withColumn("kind", kind).where("kind IS NOT NULL")
    is_kind = lambda *names: F.col("kind").isin(*names)
    return judged.select(
        *keys, "kind", F.when(is_kind("next-url"), F.col("_next")).when(is_kind("cursor"), F.col("_cursor")).alias("path"), F.when(is_kind("cursor"), nearest).when(is_kind("offset", "page"), flag).alias("more"),
        F.when(
            is_kind("offset"), F.coalesce(size(OFFSET_SIZES), F.lit(OFFSET_SIZE)),
        ).alias("step"), F.when(is_kind("offset"), F.coalesce(size(OFFSET_SIZES), F.lit(OFFSET_SIZE))).when(is_kind("page"), size(PAGE_SIZES)).alias("page_size"),
    )


def id_tokens(requests: DataFrame, keys: Sequence[str], url: str, body: str) -> DataFrame:
    """(keys, token, field, location, turn): the ids in a request: in its query, its path, and the texts of its JSON body, in this order."""
    addressed = requests.select(
        *keys,
        F.concat(
            F.filter(query_pairs(F.col(url)), lambda p: p["value"].rlike(ID)),
            F.transform(
                F.filter(F.split(urls.path_of(F.col(url)), "/"), lambda s: s.rlike(ID)),
                lambda s: F.struct(F.lit(None).cast("string").alias("key"), s.alias("value")),
            ),
        ).alias("_t"),
    )
    in_url = addressed.select(*keys, F.posexplode("_t").alias("turn", "_t")).select(
        *keys, F.col("_t.value").alias("token"), F.col("_t.key").alias("field"), F.lit("url").alias("location"), "turn",
    )
    in_body = walks.scalars(requests.select(*keys, F.col(body).alias("_b")), "_b").where(
        (F.col("kind") == "string") & (F.col("value").rlike(ID) | F.col("value").rlike(REFERENCE))
    )
    return in_url.unionByName(
        in_body.select(
            *keys, F.col("value").alias("token"), F.col("key").alias("field"), F.lit("body").alias("location"),
            ((1 << 30) + F.col("place")).cast("int").alias("turn"),
        )
    )


def provenance(entries: DataFrame, lists: DataFrame, session: str = "session", pos: str = "pos") -> DataFrame:
    """(session, token, location, config_id, source, path): for each id in a session's listing request, the response that gives it, and where.

    `entries` has session, pos (unique in it), url, request_body, content_type and response_body; `lists` the (session, pos) of the listing,
    one a session. An id is looked up by an equi-join with the texts of the session's other JSON responses. A response whose own request
    holds the id is an echo and no source; a path that names the id is of use to nobody else. Named id fields come first, then responses of
    account-like addresses, then shorter paths; then the earlier response. `config_id` is the name that the request has for the id, or the response.
    """
    mine = F.col(session).eqNullSafe(F.col("_s"))
    wanted = lists.select(F.col(session).alias("_s"), F.col(pos).alias("_list"))
    asked = entries.join(wanted, mine & (F.col(pos) == F.col("_list")))
    tokens = id_tokens(asked.select(F.col(session).alias("_s"), "url", "request_body"), ["_s"], "url", "request_body")
    named = tokens.groupBy("_s", "token").agg(F.min_by("field", F.when(F.col("field").isNotNull(), F.col("turn"))).alias("_named"))
    others = entries.join(wanted, mine & (F.col(pos) != F.col("_list"))).where(~F.coalesce(F.col("content_type"), F.lit("")).contains("html"))
    given = walks.scalars(
        others.select(session, F.col(pos).alias("source"), "url", "request_body", "response_body"), "response_body",
    ).where((F.col("kind") == "string") & (F.size(F.split("path", r"\.")) <= walks.DEPTH))
    met = given.join(named, mine & (F.col("value") == F.col("token")))
    echo = F.col("url").contains(F.col("token")) | F.coalesce(F.col("request_body").contains(F.col("token")), F.lit(False))
    parts = F.split("path", r"\.")
    last = F.element_at(parts, -1)
    score = F.when(last.rlike("(?i)id$"), 3.0).otherwise(0.0) + F.when(F.col("url").rlike(ACCOUNT_URL), 2.0).otherwise(0.0) - F.when(last.rlike("^[0-9]+$"), 1.0).otherwise(0.0) - F.length("path") / 100.0
    usable = met.where(~echo & ~F.array_contains(parts, F.col("token"))).withColumn("_score", score)
    best = usable.groupBy("_s", "token").agg(
        F.min_by(F.struct("source", "path", "_named"), F.struct((-F.col("_score")).alias("a"), "source", "place")).alias("_b")
    )
    field = F.element_at(F.split("_b.path", r"\."), -1)
    name = F.coalesce(F.col("_b._named"), F.when(field.rlike("[A-Za-z]"), field), F.lit("scopeId"))
    clean = F.nullif(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), "^_+|_+$", ""), F.lit(""))
    found = best.select(
        F.col("_s").alias("_k"), F.col("token").alias("_t"), F.coalesce(clean, F.lit("scopeId")).alias("config_id"),
        F.col("_b.source").alias("source"), F.col("_b.path").alias("path"),
    )
    places = tokens.select("_s", "token", "location").distinct()
    return places.join(found, F.col("_s").eqNullSafe(F.col("_k")) & (F.col("token") == F.col("_t"))).select(
        F.col("_s").alias(session), "token", "location", "config_id", "source", "path",
    )


def scope_id(key: Column, parent: Column) -> Column:
    """The name of the scope whose id a field holds: its own, or for `id` that of the object it is in; null for none."""
    is_scope = lambda c: F.coalesce(policy.policy_key(c).rlike(SCOPE_NAME), F.lit(False))
    return F.when(key.rlike(MEMBER_NAME), F.when(is_scope(key), key).when((key == "id") & is_scope(parent), parent))


def tenant_bindings(pages: DataFrame, resources: DataFrame, key: str = "page") -> DataFrame:
    """(key, open_url, scope, path, source): how a page can be opened again: as it is if it may be an entry, else the address with a scope's name for its one tenant, and the resource and field that give its id.

    `pages` has key, url and hosts (array, further hosts it may use); `resources` key, pos (unique in it), url, method, request_body, safe_post (whether a
    POST is a read-only query) and body. A resource counts if it is of the page's origin or hosts, was not redacted, and does not hold the tenant's
    id in its own request; a GET must have no body. In the first that has one, the first typed field level by level gives the scope.
    """
    decoded = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    url = F.col("url")
    ids = F.filter(F.filter(F.split(urls.path_of(url), "/"), lambda s: s != ""), lambda s: F.coalesce(decoded(s).rlike(policy.TENANT_ID), F.lit(False)))
    plain = (urls.query_of(url) == "") & (urls.scheme_of(url) == "https")
    is_entry = (urls.query_of(url) == "") & F.coalesce(policy.entry_url(url) == url, F.lit(False))
    open_ = pages.where(plain & ~is_entry & (F.size(ids) == 1)).select(
        F.col(key).alias("_k"), url.alias("_open"), "hosts", F.get(ids, F.lit(0)).alias("_segment"),
    ).withColumn("_tenant", decoded(F.col("_segment")))
    material = F.coalesce(decoded(F.concat(urls.path_of(url), urls.query_of(url))), F.lit(""))
    own = (F.coalesce(F.col("method"), F.lit("GET")) == "GET") & F.col("request_body").isNull() | (F.col("method") == "POST") & F.coalesce(F.col("safe_post"), F.lit(False)) & ~F.coalesce(
        F.col("request_body").contains(F.col("_tenant")), F.lit(False),
    )
    allowed = (urls.origin_of(url) == urls.origin_of(F.col("_open"))) | (urls.scheme_of(url) == "https") & F.array_contains("hosts", urls.host_of(url))
    able = resources.join(open_, F.col(key).eqNullSafe(F.col("_k"))).where(
        allowed & ~url.contains("#") & ~url.contains("REDACTED") & ~material.contains(F.col("_tenant")) & own
    )
    fields = walks.scalars(able.select("_k", "_open", "_segment", "_tenant", F.col("pos").alias("source"), "body"), "body").where(
        F.col("turn").isNotNull() & F.col("kind").isin("string", "number") & (F.col("value") == F.col("_tenant"))
    )
    typed = fields.withColumn("scope", scope_id(F.col("key"), F.col("parent"))).where("scope IS NOT NULL")
    best = typed.groupBy("_k", "_open", "_segment").agg(F.min_by(F.struct("scope", "path", "source"), F.struct("source", "turn")).alias("_b"))
    template = F.concat(F.lit("{"), F.col("_b.scope"), F.lit("}"))
    head = urls.origin_of(F.col("_open"))
    path = F.array_join(
        F.transform(F.split(F.regexp_replace(urls.path_of(F.col("_open")), "/+$", ""), "/"), lambda s: F.when(s == F.col("_segment"), template).otherwise(s)),
        "/",
    )
    bound = best.select(F.col("_k").alias(key), F.concat(head, path).alias("open_url"), "_b.scope", "_b.path", "_b.source")
    as_is = pages.where(is_entry).select(key, url.alias("open_url"), *[F.lit(None).cast(dict(bound.dtypes)[c]).alias(c) for c in ("scope", "path", "source")])
    return as_is.unionByName(bound)
