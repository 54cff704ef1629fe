"""Policy predicates over URLs, names and responses, as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Names that stand for secrets, tenants and billing, and shapes of identifiers and credentials.
SECRET_KEY = r"(?i)(?:^|_)(?:access_?token|api_?key|auth|authorization|code|credential|jwt|secret|session|sig|signature)(?:$|_)"
SECRET_NAME = r"(?i)(?:^|_)(?:token|secret|password|passwd|passcode|credential|private_?key|auth(?:orization)?|session|cookie|csrf|xsrf)(?:_|$)"
TENANT_NAME = r"^(?:workspace|organization|org|team|project|tenant|account|customer)s?(?:_id)?$"
TENANT_CONTAINER = r"(?i)^(?:account|accounts|organization|organizations|org|orgs|workspace|workspaces|team|teams|project|projects|tenant|tenants|customer|customers)$"
BILLING_SEGMENT = r"(?i)^(?:billing|billings|invoice|invoices|receipt|receipts|payment|payments|subscription|subscriptions|statement|statements|transaction|transactions)$"
BILLING_ROUTE = r"(?i)(?:^|/)(?:billing|billings|invoice|invoices|receipt|receipts|payment|payments|subscription|subscriptions|statement|statements|transaction|transactions)(?:/|$)"
MUTATING_ROUTE = r"(?i)(?:^|/)(?:logout|log-out|signout|sign-out|delete|remove|cancel|checkout|purchase|upgrade|downgrade|authorize|oauth|callback|invite|payment[-_]?method)(?:/|$)"
FRAGMENT_SEGMENT = r"^[A-Za-z0-9._~-]{1,64}$"
BILLING_INTENT = r"(?i)billing|invoice|receipt|statement"
ROOT_CONTEXT = r"(?i)^(?:settings|account|accounts|admin|workspace|workspaces|team|teams)$"
TENANT_ID = r"(?i)^(?:[0-9a-f]{24}|[0-9a-f]{32}|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|\d{7,20})$"
CREDENTIAL = r"(?i)^(?:eyJ[A-Za-z0-9_-]{16,}|[A-Za-z0-9_-]{24,}|[0-9a-f]{32,}|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|\d{7,})$"
QUERY_VALUE = r"^[A-Za-z0-9_.:+-]{1,64}$"
LOGIN_PATH, LOGIN_HOST = r"(?i)(?:^|/)(?:auth|login|log-in|signin|sign-in|sso)(?:/|$)", r"(?i)^(?:auth|login|signin|sso)\."
HEADER_NAME, AUTH_HEADER = r"^[a-z0-9][a-z0-9-]{0,63}$", r"(?:^|[-])(?:auth|token|key|secret|session|csrf|xsrf)(?:[-]|$)"
RESERVED_HEADERS = ("authorization", "content-type", "idempotency-key")
MAX_SEGMENT = 96


def policy_key(name: Column) -> Column:
    """A name in lower-case words with `_` between."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), r"[-\s]+", "_"))


def is_secret_name(name: Column) -> Column:
    key = policy_key(name)
    return key.rlike(SECRET_KEY) | key.rlike(SECRET_NAME)


def is_tenant_name(name: Column) -> Column:
    return policy_key(name).rlike(TENANT_NAME)


def is_tenant_id(value: Column) -> Column:
    """24 or 32 hex digits, a UUID, or 7 to 20 digits."""
    return value.rlike(TENANT_ID)


def looks_credential(value: Column) -> Column:
    """Whether a path segment or query value has the shape of a credential; what can't be decoded counts as one."""
    return ~value.contains("{") & F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))).rlike(CREDENTIAL), F.lit(True))


def is_unsafe_path(path: Column) -> Column:
    """Whether a path has a segment over MAX_SEGMENT letters, or one like a credential that is not the one tenant of a billing route."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    suspects = F.size(F.filter(segments, looks_credential))

    def allowed(s: Column, i: Column) -> Column:
        later = F.slice(segments, i + 2, F.greatest(F.size(segments) - i - 1, F.lit(0)))
        root = s.rlike(r"^\d{7,20}$") & F.exists(later, lambda x: x.rlike(ROOT_CONTEXT)) & F.exists(later, lambda x: x.rlike(BILLING_INTENT))
        inner = F.coalesce(F.get(segments, i - 1).rlike(TENANT_CONTAINER), F.lit(False)) & F.exists(later, lambda x: x.rlike(BILLING_SEGMENT))
        return (suspects == 1) & is_tenant_id(s) & F.when(i == 0, root).otherwise(inner)

    bad = F.transform(segments, lambda s, i: (F.length(s) > MAX_SEGMENT) | (looks_credential(s) & ~allowed(s, i)))
    return F.exists(bad, lambda b: b)


def is_query_value(key: Column, value: Column) -> Column:
    """Whether a discovered query value may be kept: a template, a tenant's identifier under a tenant's name, or plain route structure."""
    structural = value.rlike(QUERY_VALUE) & (~looks_credential(value) | value.rlike(r"^\d{1,20}$"))
    return ~is_secret_name(key) & (F.length(value) <= 160) & (value.contains("{") | (is_tenant_name(key) & is_tenant_id(value)) | structural)


def billing_fragment(url: Column) -> Column:
    """The hash of an address if it is a route to billing: plain segments, none like a credential, none that changes anything; empty otherwise."""
    raw = F.regexp_extract(url, "(?s)#(.*)$", 1)
    segments = F.filter(F.split(raw, "/"), lambda s: s != "")
    route = raw.rlike(BILLING_ROUTE) & ~raw.rlike(MUTATING_ROUTE) & ~raw.rlike(r"[?=&%\\]") & (F.length(raw) <= 240)
    return F.when(route & F.forall(segments, lambda s: s.rlike(FRAGMENT_SEGMENT) & ~looks_credential(s)), F.concat(F.lit("#"), raw)).otherwise("")


def entry_url(url: Column) -> Column:
    """A page to begin at, without its query, and with its hash only if that is a billing route and there was no query; `/` for its path if that is unsafe; null unless it is https without user data."""
    path = F.when(is_unsafe_path(urls.path_of(url)), F.lit("/")).otherwise(urls.path_of(url))
    fragment = F.when(urls.query_of(url) == "", billing_fragment(url)).otherwise("")
    return F.when((urls.scheme_of(url) == "https") & (urls.host_of(url) != "") & ~url.rlike("^[^/]*//[^/?#]*@"), F.concat(urls.origin_of(url), path, fragment))


def is_origin_pattern(value: Column) -> Column:
    """An exact https origin of a public host, with any path: https://host/*."""
    host = F.regexp_extract(value, r"^https://([A-Za-z0-9.-]+)(?::\d+)?/\*$", 1)
    return (host != "") & urls.is_public_host(F.lower(host))


def redirect_outcome(final: Column, expected: Column) -> Column:
    """What a redirect to `final` means where `expected` was asked for: session_expired, blocked_or_challenged, or null for the same page."""
    bare = lambda u: F.when(F.length(urls.path_of(u)) > 1, F.regexp_replace(urls.path_of(u), "/$", "")).otherwise(urls.path_of(u))
    same = (urls.origin_of(final) == urls.origin_of(expected)) & (bare(final) == bare(expected)) & (urls.query_of(final) == urls.query_of(expected))
    return (
        F.when(F.coalesce(final, F.lit("")) == "", "blocked_or_challenged")
        .when(urls.path_of(final).rlike(LOGIN_PATH) | urls.host_of(final).rlike(LOGIN_HOST), "session_expired").when(~same, "blocked_or_challenged")
    )


def content_class(value: Column) -> Column:
    """One of eight classes of a content type; parameters do not count."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(value, F.lit("")), F.lit(";"), F.lit(1))))
    return (
        F.when(kind == "", "missing").when(kind == "application/pdf", "pdf").when(kind.isin("text/html", "application/xhtml+xml"), "html")
        .when((kind == "application/json") | kind.endswith("+json"), "json").when(kind.startswith("text/"), "text").when(kind.startswith("image/"), "image")
        .when(kind == "application/octet-stream", "binary").otherwise("other")
    )


def sink_outcome(status: Column, duplicate: Column) -> Column:
    """What an HTTP sink's answer means: deduped, unauthorized, failed or accepted."""
    twice = F.coalesce(duplicate, F.lit(False))
    return F.when((status == 409) & twice, "deduped").when(status.isin(401, 403), "unauthorized").when(~status.between(200, 299), "failed").when(twice, "deduped").otherwise("accepted")


def header_marker(name: Column, value: Column) -> Column:
    """How a request header takes part in authentication: bearer, basic, custom, or null."""
    key = F.lower(name)
    named = key.isin("authorization", "proxy-authorization")
    scheme = F.when(named & value.rlike(r"(?i)^bearer(?:\s|$)"), "bearer").when(named & value.rlike(r"(?i)^basic(?:\s|$)"), "basic")
    custom = named | key.isin("cookie", "set-cookie") | key.rlike(AUTH_HEADER) | key.startswith("x-")
    return F.when(key.rlike(HEADER_NAME), F.coalesce(scheme, F.when(custom, F.lit("custom"))))


def disposition_filename(header: Column) -> Column:
    """The file name of a Content-Disposition header: its encoded form first, else the quoted or bare one; the last path part, null if blank or over 240 letters."""
    encoded = F.regexp_replace(F.regexp_extract(header, r"(?i)filename\*\s*=\s*UTF-8''([^;]+)", 1), "^[\"']|[\"']$", "")
    quoted, bare = F.regexp_extract(header, r'(?i)filename\s*=\s*"([^"]+)"', 1), F.trim(F.regexp_extract(header, r"(?i)filename\s*=\s*([^;]+)", 1))
    name = F.coalesce(
        F.try_url_decode(F.nullif(F.replace(encoded, F.lit("+"), F.lit("%2B")), F.lit(""))), F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit("")),
    )
    last = F.trim(F.element_at(F.split(name, r"[\\/]"), -1))
    return F.when((last != "") & (F.length(last) <= 240), F.regexp_replace(last, r"[\x00-\x1f\x7f]", "_"))


def id_from_href(href: Column) -> Column:
    """An id for a document's address: its last segment if that names something, with 24 digits of the address' hash; else `document-` and those."""
    digest = F.substring(F.sha2(href, 256), 1, 24)
    last = F.regexp_replace(
        F.coalesce(F.element_at(F.filter(F.split(F.split_part(href, F.lit("?"), F.lit(1)), "/"), lambda s: s != ""), -1), F.lit("")), r"(?i)\.pdf$",
        "",
    )
    names = (F.length(last) > 3) & ~F.lower(last).rlike(f"^(?:{urls.GENERIC_SEGMENT})$")
    return F.when(names, F.concat(last, F.lit("-"), digest)).otherwise(F.concat(F.lit("document-"), digest))


def folder_path(root: Column, depth: int = 6) -> Column:
    """A folder as segments that are safe to save under: parts of dots alone go, forbidden characters become dashes, `depth` parts at most."""
    parts = F.filter(F.transform(F.split(root, r"[/\\]+"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^\.+$"))
    clean = lambda p: F.trim(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r'[/\\:*?"<>|]', "-"), r"[\x00-\x1f]", ""), r"\s+", " "), r"^\.+", "")
    )
    return F.array_join(F.slice(F.filter(F.transform(parts, clean), lambda p: p != ""), 1, depth), "/")


def normalised(field: str, c: Column) -> Column:
    """A claim's value as its field wants it: white space made single, 120 letters (240 of a file name); null for what is no value of that field."""
    value = F.nullif(F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 240 if field == "filename" else 120), F.lit(""))
    if field == "issuedAt":
        day = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})(?:$|T)", 1)
        return F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)
    if field == "total":
        number = F.replace(F.regexp_replace(value, r"\s", ""), F.lit(","), F.lit("."))
        return F.when(number.rlike(r"^-?\d{1,18}(?:\.\d{1,6})?$"), number)
    if field == "currency":
        return F.when(value.rlike("^[A-Za-z]{3}$"), F.upper(value))
    return F.regexp_replace(value, r"[/\\\x00-\x1f\x7f]", "_") if field == "filename" else value


def continuation_end(timed_out: Column, capped: Column, actions: Column, elapsed_ms: Column, documents: Column, most: tuple[int, int, int]) -> Column:
    """Why a page's continuation stops, the first of: time_cap and action_cap of the page, action_cap, time_cap, document_cap; null to go on."""
    return F.when(timed_out, "time_cap").when(
        capped | (actions >= most[0]), "action_cap",
    ).when(elapsed_ms >= most[1], "time_cap").when(documents >= most[2], "document_cap")


def month_bounds(first: Column, last: Column) -> Sequence[Column]:
    """Template values of a window of months `YYYY-MM`: first and last day, the day after, and their epoch milliseconds in UTC."""
    start, end = F.to_date(F.concat(first, F.lit("-01"))), F.last_day(F.to_date(F.concat(last, F.lit("-01"))))
    ms = lambda d: F.unix_date(d).cast("long") * 86_400_000
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    return [
        F.year(start).alias("from_year"), F.date_format(start, "MM").alias("from_month"), day(start).alias("from_date"), ms(start).alias("from_ms"),
        day(end).alias("through_date"), day(F.date_add(end, 1)).alias("to_exclusive_date"), ms(F.date_add(end, 1)).alias("to_exclusive_ms"),
    ]
