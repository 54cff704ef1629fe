"""Which addresses and headers may be used: continuations, observed documents, a recipe's hosts, and where results are sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import policy, urls

CONTINUATION_CHARS, PATH_CHARS, VALUE_CHARS, URL_CHARS = 1200, 320, 512, 2048
# What continuations may ask for, where they may not lead, and what documents and other files look like.
PAGE_KEY = r"(?i)^(?:page|p|offset|start|cursor|after|before|starting_after|page_token|continuation|per_page|limit)$"
BILLING = r"(?i)billing|invoice|receipt|statement|payment|transaction|subscription"
MUTATING = r"(?i)(?:^|/)(?:cancel|checkout|delete|logout|payment-method|payment_methods?|remove|revoke|signout|terminate)(?:/|$)"
PAGE_PATH = r"(?i)(?:^|/)(?:page|offset)/\d+(?:/|$)"
DOCUMENT_ROUTE = r"(?i)(?:^|[/.?&=_-])(?:invoices?|receipts?|statements?|documents?|downloads?|pdf)(?:$|[/.?&=_-])"
OTHER_TYPE = r"(?i)(?:json|html|javascript|ecmascript|css|image/|font/|audio/|video/)"


def _plain(url: Column) -> Column:
    return (urls.scheme_of(url) == "https") & (urls.host_of(url) != "") & ~url.rlike("^[^/]*//[^/?#]*@")


def continuation_url(url: Column, origin: Column) -> Column:
    """A listing's next page, given in full or from the root of `origin`; null unless it stays there, is about billing, changes nothing, and asks for a page and nothing else."""
    full = F.when(url.startswith("/"), F.concat(origin, url)).otherwise(url)
    path = urls.path_of(full)
    pairs = F.filter(F.split(urls.query_of(full), "&"), lambda kv: kv != "")
    key, value = (lambda kv: F.regexp_extract(kv, "^([^=]*)", 1)), (
        lambda kv: F.coalesce(F.try_url_decode(F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1)), F.lit(""))
    )
    asks = F.forall(pairs, lambda kv: key(kv).rlike(PAGE_KEY) & ~key(kv).rlike(policy.SECRET_KEY) & (F.length(value(kv)) <= VALUE_CHARS))
    good = _plain(full) & (urls.origin_of(full) == origin) & ~full.contains("#") & (F.length(path) <= PATH_CHARS) & path.rlike(BILLING) & ~path.rlike(MUTATING) & asks & (
        (F.size(pairs) > 0) | path.rlike(PAGE_PATH)
    )
    return F.when((F.length(url) <= CONTINUATION_CHARS) & good, full)


def observed_document(url: Column, method: Column, content_type: Column, filename: Column, intended: Column, origins: Column) -> Column:
    """The address of a document that a page asked for, without its hash; null unless it is a GET of one of `origins` (array) and a PDF by its type, was meant as a document (`intended`), or has the shape of one and the type of nothing else."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    query = F.when(urls.query_of(url) != "", F.concat(F.lit("?"), urls.query_of(url))).otherwise("")
    shaped = F.concat(urls.path_of(url), query, F.lit(" "), F.coalesce(filename, F.lit(""))).rlike(DOCUMENT_ROUTE)
    wanted = (kind == "application/pdf") | F.coalesce(intended, F.lit(False)) | ~kind.rlike(OTHER_TYPE) & shaped
    good = (F.upper(method) == "GET") & (F.length(url) <= URL_CHARS) & _plain(url) & F.array_contains(origins, urls.origin_of(url)) & wanted
    return F.when(good, F.regexp_replace(url, "#.*$", ""))


def is_allowed(url: Column, hosts: Column) -> Column:
    """Whether an address is of one of a recipe's host patterns `https://host/*`; patterns with a wildcard in the host admit nothing."""
    exact = F.filter(hosts, lambda h: h.endswith("/*") & ~h.contains("*."))
    return F.coalesce(F.exists(exact, lambda h: urls.origin_of(h) == urls.origin_of(url)) & (urls.host_of(url) != ""), F.lit(False))


def sink_refusal(endpoint: Column, headers: Column, token: Column, token_hosts: Column) -> Column:
    """Why results may not be sent to an endpoint: `endpoint` (no https, but for this machine), `header` (a reserved one is given), `token` (a credential for a host that is not listed); null if they may."""
    host = urls.host_of(endpoint)
    local = host.isin("localhost", "127.0.0.1")
    named = F.exists(token_hosts, lambda h: F.lower(F.trim(h)) == host)
    return (
        F.when((host == "") | (urls.scheme_of(endpoint) != "https") & ~local, "endpoint").when(
            F.exists(headers, lambda h: F.lower(h).isin(*policy.RESERVED_HEADERS)), "header",
        )
        .when(token.isNotNull() & ~F.coalesce(named, F.lit(False)), "token")
    )
