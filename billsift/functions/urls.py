"""URL predicates, scores and templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

# Words of the route policy.
INTENT = "invoice|receipt|billing|payment|subscription|statement|transaction"
UNSAFE = "logout|log-out|signout|sign-out|delete|remove|cancel|checkout|purchase|upgrade|downgrade|authorize|oauth|callback|invite|payment[-_/]?method"
DIRECT_DOCUMENT = r"\.pdf$|(?:^|/)(?:download|pdf)(?:/|$)|(?:^|/)(?:invoice|receipt|statement)s?/[^/]+$"
PATH_POINTS = (("invoice|receipt", 18), ("billing", 15), ("history|statement|transaction", 8), ("payment|subscription", 5), ("settings|account", 2))
ROUTE_WORDS = "app|v|t|home|dashboard|manage|admin|account|accounts|organization|organizations|org|workspace|workspaces|team|teams|settings|preferences|billing|billings|invoice|invoices|receipt|receipts|payment|payments|subscription|subscriptions|statement|statements|transaction|transactions|history|plans|login"
ROUTE_ID = r"\d{4,}|[0-9a-f]{12,}|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|(?:inv|invoice|receipt|rcpt|team|workspace|account)[_-][a-z0-9_-]{4,}"
VOLATILE_KEY = "x-amz-|x-goog-|signature$|sig$|expires?$|token$|policy$|key-pair-id$|response-content-"
GENERIC_SEGMENT = "download|document|file|invoice|pdf|receipt|view"
PAGE_KEYS = ("page", "offset", "limit", "per_page", "cursor")
# Reserved IPv4 blocks, as address and prefix length.
RESERVED = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "224.0.0.0/3", "100.64.0.0/10", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host_of(url: Column) -> Column:
    """Host without user, port or upper case; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"\A\z", "/")


def without_dots(path: Column) -> Column:
    """A path from the root with its segments `.` and `..` (also escaped) followed."""
    return bound(path, _without_dots)


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/", -1)
    dots = lambda s, n: F.lower(s).rlike(r"^(?:\.|%2e){" + str(n) + "}$")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))
    followed = F.aggregate(
        F.slice(segments, 2, F.size(segments)), F.array(F.lit("")),
        lambda a, s: F.when(dots(s, 2), up(a)).when(dots(s, 1), a).otherwise(F.concat(a, F.array(s))),
    )
    ends = F.when(dots(F.element_at(segments, -1), 1) | dots(F.element_at(segments, -1), 2), F.lit("/")).otherwise("")
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.concat(F.array_join(followed, "/"), ends)).otherwise(path)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def origin_of(url: Column) -> Column:
    return F.concat(scheme_of(url), F.lit("://"), host_of(url))


def is_public_host(host: Column) -> Column:
    """A dotted name that is not local, or an IPv4 address outside the reserved blocks."""
    return bound(host, _is_public_host)


def _is_public_host(host: Column) -> Column:
    octets = F.split(host, r"\.")
    number = reduce(lambda a, b: a * 256 + b, [F.try_element_at(octets, F.lit(i)).try_cast("bigint") for i in range(1, 5)])
    address = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    blocks = []
    for block in RESERVED:
        base, bits = block.split("/")
        low = reduce(lambda a, b: a * 256 + b, map(int, base.split(".")))
        blocks.append((low, low + (1 << (32 - int(bits))) - 1))
    reserved = bound(number, lambda n: reduce(Column.__or__, [n.between(low, high) for low, high in blocks]))
    named = host.contains(".") & ~host.rlike(r"(?:^|\.)(?:localhost|local)$")
    return F.when(address, ~reserved).otherwise(named)


def safe_route(url: Column) -> Column:
    """The URL without hash and with its paging keys only, sorted; null unless it is https, public, and neither mutating nor a document itself."""
    return bound(url, _safe_route)


def _safe_route(url: Column) -> Column:
    path = path_of(url)
    for _ in range(3):  # what is escaped once or more often is judged as what it stands for
        path = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    path = F.lower(path)
    keys = F.filter(F.split(query_of(url), "&"), lambda kv: F.regexp_extract(kv, "^([^=]*)", 1).isin(*PAGE_KEYS) & kv.rlike(r"=\d+$"))
    query = F.array_join(F.array_sort(keys), "&")
    bad = bound(path, lambda p: p.rlike(UNSAFE) | p.rlike(DIRECT_DOCUMENT)) | url.rlike("^[^/]*//[^/?#]*@")
    kept = F.concat(origin_of(url), path_of(url), bound(query, lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))))
    return F.when((scheme_of(url) == "https") & is_public_host(host_of(url)) & ~bad, kept)


def route_template(url: Column) -> Column:
    """The path with known words kept, identifiers as `:id` and the rest as `:segment`; 12 segments and 160 characters at most."""
    segments = F.slice(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), 1, 12)
    named = F.transform(
        segments,
        lambda s: F.when(
            F.lower(s).rlike(f"^(?:{ROUTE_WORDS})$"), F.lower(s),
        ).when(F.lower(s).rlike(f"^(?:{ROUTE_ID})$"), F.lit(":id")).otherwise(F.lit(":segment")),
    )
    route = F.concat(F.lit("/"), F.array_join(named, "/"))
    return F.when(F.length(route) <= 160, route).otherwise(F.lit("/:segment"))


def path_score(path: Column) -> Column:
    low = F.lower(path)
    return reduce(Column.__add__, [F.when(low.rlike(words), F.lit(points)).otherwise(F.lit(0)) for words, points in PATH_POINTS])


def stability_score(url: Column) -> Column:
    """How stable a document URL looks: a path that ends in `.pdf` 3, with a segment `pdf` 2, with a segment `download` 1, other 0, no URL -1."""
    path = F.lower(path_of(url))
    return F.when(host_of(url) == "", F.lit(-1)).when(path.endswith(".pdf"), F.lit(3)).when(path.rlike(r"(?:^|/)pdf(?:/|\z)"), F.lit(2)).when(
        path.rlike(r"(?:^|/)download(?:/|\z)"), F.lit(1),
    ).otherwise(F.lit(0))


def canonical_document_url(url: Column) -> Column:
    """Without `.pdf` and hash; volatile query keys go if the path or another key identifies the document; keys are sorted."""
    path = F.regexp_replace(path_of(url), r"(?i)\.pdf\z", "")
    last = F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1)
    stable_path = F.coalesce((F.length(last) > 3) & ~F.lower(last).rlike(f"^(?:{GENERIC_SEGMENT})$"), F.lit(False))
    pairs = F.filter(F.split(query_of(url), "&"), lambda kv: kv != "")
    lasting = F.filter(pairs, lambda kv: ~F.lower(F.regexp_extract(kv, "^([^=]*)", 1)).rlike(f"^(?:{VOLATILE_KEY})"))
    kept = F.array_join(F.array_sort(F.when(stable_path | (F.size(lasting) > 0), lasting).otherwise(pairs)), "&")
    return F.concat(origin_of(url), path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


def provider_document(url: Column) -> Column:
    """A hosted invoice page as its document: `/i/a/b` becomes `/invoice/a/b/pdf`."""
    return F.regexp_replace(url, r"^(https://[^/]+)/i/([^/?#]+)/([^/?#]+).*$", "$1/invoice/$2/$3/pdf")


def next_in_link_header(header: Column) -> Column:
    """The target of the `next` relation of a Link header of at most 4096 characters and 20 parts."""
    parts = F.slice(F.split(header, r",\s*(?=<)"), 1, 20)
    following = F.filter(parts, lambda p: p.rlike(r"""(?i);\s*rel\s*=\s*"?(?:[^";]*\s)?next(?:\s[^";]*)?"?\s*(?:;|$)"""))
    return F.when((F.length(header) <= 4096) & (F.size(following) > 0), F.regexp_extract(F.get(following, F.lit(0)), "<([^>]*)>", 1))


# Words in front of a supplier's name in its host, and public suffixes behind it.
SERVICE_LABELS = ("www", "app", "api", "dashboard", "my", "portal", "secure", "account", "accounts", "billing", "console", "admin", "pay")
SUFFIX_LABELS = ("com", "net", "org", "io", "ai", "co", "app", "dev", "se", "eu", "de", "uk", "us", "gov")


def vendor_id(host: Column) -> Column:
    """The last label of a host that is neither a service word nor one of the suffixes at its end, in kebab case; `vendor` if nothing is left."""
    labels = F.filter(F.split(host, r"\."), lambda w: ~w.isin(*SERVICE_LABELS))
    # the last label that is no suffix; if all are, the first stays
    named = F.filter(F.transform(labels, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: (x["i"] == 0) | ~x["w"].isin(*SUFFIX_LABELS))
    label = F.coalesce(F.nullif(F.try_element_at(named, F.lit(-1))["w"], F.lit("")), host)
    bare = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when((host == "") | (bare == ""), F.lit("vendor")).otherwise(bare)
