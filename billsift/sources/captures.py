"""What may be kept of captured traffic: addresses, forms, pages and JSON bodies without personal data and secrets.

Addresses, forms and pages are columns. JSON is walked in an Arrow function that only decides what goes; addresses
inside a body come back as holes that the same column fills, so there is one rule for them. Identifiers become
references numbered by first sight within a session, by ranges, so that a session is never gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls, values
from ..functions.binding import bound
from ..operators.numbering import numbered, written
from ..session import ship
from .walks import KEEP, KEYS_HELD, PAYMENT_KEY, SENSITIVE_KEY, dumped, each_text, hidden_names, is_payment, loaded, policy_key, rewritten

BODY_CHARS, LINKS, LINK_CHARS, PATHS, PATH_CHARS = 1_500_000, 500, 2048, 40, 300
TRUNCATED, MALFORMED = '{"__truncated__":true}', '{"__malformed__":true}'
MULTIPART = "[multipart body omitted]"
# Identifiers, addresses and their ends are marked by private-use characters until they are replaced.
MARK, END = "\ue000", "\ue001"

# What is structure and not data, in addresses, JSON and queries.
SAFE_QUERY_KEYS = ("limit", "offset", "page", "per_page", "page_size", "sort", "order", "status", "type", "include", "include_archived")
SAFE_QUERY_VALUE = r"(?i)^(?:\d{1,4}|true|false|[a-z][a-z0-9_-]{0,31})$"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
OPAQUE = rf"(?:(?i:{UUID})|[0-9]{{6,}}|[A-Za-z0-9_-]{{16,}})"
PERSON_PARENT = r"(?i)^(?:customers?|users?|members?|contacts?|people|recipients?)$"
PERSON_NAME = r"^[A-Za-z][A-Za-z.'-]{1,63}$"
MAIL = r"(?<![^\s@])[^\s@]+@[^\s@]+\.[^\s@]+"
ANCHOR = r"""(?i)<a\b[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>"""
NO_LINK = r"(?i)^\s*(?:javascript|data|mailto|tel):"
PERSONAL_KEY = re.compile(r"(?:^|_)(?:email|name|recipient|address|phone|vat|tax|ssn|personnummer|customer)(?:_|$)")
STRUCTURAL_NAMES = frozenset(("operation_name", "file_name", "filename"))
ID_KEY = re.compile(r"^id$|_id$|(?:account|team|workspace|organization|org|tenant|customer)[_-]?id$", re.I)
DATE_KEY = re.compile(r"(?:^|_)(?:date|created|issued|period_end|timestamp)(?:_|$)|(?:date|created|issued|periodEnd|timestamp)(?:At)?$", re.I)
DATE = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?", re.A)
CURRENCY_KEY, CURRENCY = re.compile("currency|curr|currency_code", re.I), re.compile("[A-Za-z]{3}")
UNSAFE_KEY = re.compile(rf"[^\s@]+@[^\s@]+\.[^\s@]+\Z|(?:{UUID})\Z|(?=.*[a-z])(?=.*[0-9])[a-z0-9_-]{{24,}}\Z|(?:sk|pk|rk|api)_(?:live|test|prod)_", re.I)
INVOICE_ID = re.compile(r"(?:inv|invoice|in)[_-][A-Za-z0-9-]{1,128}", re.I)
OPERATION, PLACEHOLDER = re.compile(r"[_A-Za-z][_0-9A-Za-z]{0,127}"), re.compile(r"\{[A-Za-z_][A-Za-z0-9_]*\}")
CHOICE_KEY, CHOICE = re.compile("status|type|sort|order", re.I), re.compile("[a-z][a-z0-9_-]{0,31}", re.I)
QUERY = re.compile(r"query(?:\s+[_A-Za-z][_0-9A-Za-z]*)?\s*(?:\([^)]*\)\s*)?\{")
QUERY_CHARS = 48 * 1024
TOLD_PATH = re.compile(r"[A-Za-z0-9_$-]+(?:\.[A-Za-z0-9_$-]+)*")
HOLE = re.compile(f"{MARK}[0-9]+{END}")
ADDRESS = re.compile("https?://|/", re.I)


def _decoded(c: Column, form: bool = False) -> Column:
    """Percent-decoded; what is no escape stays as it is. `form`: a plus is a blank."""
    def whole(c: Column) -> Column:
        kept = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
        return F.coalesce(F.try_url_decode(kept if form else F.replace(kept, F.lit("+"), F.lit("%2B"))), c)

    signs = lambda c: c.contains("%") | c.contains("+") if form else c.contains("%")
    return bound(c, lambda c: F.when(signs(c), whole(c)).otherwise(c))


def _pairs(query: Column) -> Column:
    """The keys and values of a query or form, decoded, in order."""
    pairs = F.filter(F.split(query, "&"), lambda kv: kv != "")
    return F.transform(
        pairs,
        lambda kv: F.struct(
            _decoded(F.regexp_extract(kv, "(?s)^([^=]*)", 1), True).alias("key"),
            _decoded(F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1), True).alias("value"),
        ),
    )


def form_body(body: Column) -> Column:
    """A url-encoded form with every value redacted; each key once, in order of first sight."""
    keys = F.array_distinct(F.transform(_pairs(F.regexp_replace(body, r"^\?", "")), lambda p: p["key"]))
    return F.array_join(F.transform(keys, lambda k: F.concat(F.url_encode(k), F.lit("=REDACTED"))), "&")


def resolved_path(path: Column) -> Column:
    """A path from the root, its dot segments followed and what a path may not hold escaped."""
    rooted = F.translate(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "\\", "/")
    return bound(urls.without_dots(rooted), _escaped_path)


def _escaped_path(plain: Column) -> Column:
    escaped = F.array_join(
        F.transform(
            F.split(plain, ""),
            lambda c: F.when(c.rlike(r"[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c),
        ),
        "",
    )
    return F.when(plain.rlike(r"[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"), escaped).otherwise(plain)


def sanitised_url(url: Column, aliased: bool = False) -> Column:
    """An address as structure: no user, no hash, personal and key-like segments and all but plain listing values redacted.

    Only http and https keep their host; others are their path and query. With `aliased`, segments and identifier
    values are marked for `captured` to number them. What is no address is redacted as text.
    """
    gone = lambda s: F.concat(F.lit(MARK), s, F.lit(END)) if aliased else F.lit("REDACTED")

    def whole(text: Column, bare: Column) -> Column:
        host = F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?\\]*@)?([^/?\\]*)", 1)
        scheme = F.lower(F.regexp_extract(text, "(?i)^(https?)://", 1))
        return bound(scheme, lambda scheme: bound(host, lambda host: addressed(bare, scheme, host)))

    def addressed(bare: Column, scheme: Column, host: Column) -> Column:
        path = F.regexp_extract(bare, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?\\]*)?([^?]*)", 1)
        query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
        port = F.when(scheme == "https", ":443").otherwise(":80")
        lower = F.lower(host)
        named = F.when(lower.endswith(port), F.substr(lower, F.lit(1), F.length(lower) - F.length(port))).otherwise(lower)
        front = F.when(scheme != "", F.concat(scheme, F.lit("://"), named)).otherwise("")
        opaque = bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)")
        way = bound(path, lambda path: F.when(opaque, path).otherwise(bound(F.split(resolved_path(path), "/", -1), joined)))
        told = F.concat(front, way, bound(query, lambda query: F.when(query == "", "").otherwise(bound(judged(query), lambda pairs: search(query, pairs)))))
        return F.when((scheme != "") & ((host == "") | host.rlike(r"[\s<>^|%]")), values.redacted(url)).otherwise(told)

    def joined(segments: Column) -> Column:
        def hidden(own: Column, i: Column) -> Column:
            secret = own.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f-]{27}$") | (F.length(own) >= 24) & own.rlike(r"^[A-Za-z0-9._~+=-]+$") & own.rlike("[A-Za-z]") & own.rlike("[0-9]")
            person = _decoded(F.coalesce(F.get(segments, i - 1), F.lit(""))).rlike(PERSON_PARENT) & (own.rlike(f"^{MAIL}$") | own.rlike(PERSON_NAME))
            return secret | person

        kept = lambda s, i: bound(_decoded(s), lambda own: F.when(hidden(own, i), gone(own)).otherwise(s))
        return F.array_join(F.transform(segments, kept), "/")

    def judged(query: Column) -> Column:
        return F.transform(
            _pairs(query),
            lambda p, i: bound(
                p, lambda p: F.struct(
                    i.alias("i"), p["key"].alias("key"), p["value"].alias("value"),
                    (F.lower(p["key"]).isin(*SAFE_QUERY_KEYS) & p["value"].rlike(SAFE_QUERY_VALUE)).alias("safe"),
                ),
            ),
        )

    def search(query: Column, pairs: Column) -> Column:
        return F.when(F.forall(pairs, lambda p: p["safe"]), F.concat(F.lit("?"), query)).otherwise(
            F.concat(F.lit("?"), F.array_join(bound(F.filter(pairs, lambda p: ~p["safe"]), lambda unsafe: listed(pairs, unsafe)), "&")),
        )

    def listed(pairs: Column, unsafe: Column) -> Column:
        """The values of safe keys, and each key that is unsafe anywhere at its first place, with the first unsafe value hidden."""
        first = lambda of, key: F.get(F.filter(of, lambda q: q["key"] == key), F.lit(0))
        hidden = lambda v: F.when(v.rlike(f"^{OPAQUE}$"), gone(v)).otherwise("REDACTED") if aliased else F.lit("REDACTED")

        def told(p: Column, bad: Column) -> Column:
            plain = lambda v: F.concat(F.url_encode(p["key"]), F.lit("="), v)
            return F.when(bad.isNull(), plain(F.url_encode(p["value"]))).when(p["i"] == first(pairs, p["key"])["i"], plain(bound(bad["value"], hidden)))

        return F.filter(F.transform(pairs, lambda p: bound(first(unsafe, p["key"]), lambda bad: told(p, bad))), lambda t: t.isNotNull())

    cleaned = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    return bound(cleaned, lambda text: bound(F.regexp_replace(text, "(?s)#.*$", ""), lambda bare: whole(text, bare)))


def html_links(html: Column, most: int = LINKS) -> Column:
    """The targets of a page's links as sanitised anchors, the first `most`; nothing else of the page stays."""
    quoted = lambda tag: F.coalesce(*[F.nullif(F.regexp_extract(tag, ANCHOR, k), F.lit("")) for k in (1, 2, 3)])
    raw = F.filter(F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), quoted), lambda x: x.isNotNull() & ~x.rlike(NO_LINK))
    clean = F.slice(F.filter(F.transform(raw, lambda x: sanitised_url(x)), lambda x: F.length(x) <= LINK_CHARS), 1, most)

    def escaped(x: Column) -> Column:
        for plain, escape in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(plain), F.lit(escape))
        return x

    return F.array_join(F.transform(clean, lambda x: F.concat(F.lit('<a href="'), escaped(x), F.lit('"></a>'))), "")


def _is_structural_query(text: str) -> bool:
    if len(text) > QUERY_CHARS or re.search("[\"']", text):
        return False
    text = re.sub(r"#[^\r\n]*", " ", text).strip()
    return bool(QUERY.match(text)) and not re.search(r"\b(?:mutation|subscription)\b", text, re.I)


#: What a string may be under a name, to be structure and not data: (name, text) tests for any body, and for requests.
APPROVED = [
    lambda k, t, request: DATE_KEY.search(k) and DATE.fullmatch(t),
    lambda k, t, request: CURRENCY_KEY.fullmatch(k) and CURRENCY.fullmatch(t),
    lambda k, t, request: not request and ID_KEY.search(k) and INVOICE_ID.fullmatch(t),
    lambda k, t, request: request and k == "operationName" and OPERATION.fullmatch(t),
    lambda k, t, request: request and k == "query" and _is_structural_query(t),
    lambda k, t, request: request and k not in ("operationName", "query") and (PLACEHOLDER.fullmatch(t) or CHOICE_KEY.fullmatch(k) and CHOICE.fullmatch(t)),
]


@lru_cache(KEYS_HELD)
def _goes(key: str) -> bool:
    """Whether a member's name says that its value is a secret, a payment or a person's."""
    name = policy_key(key)
    personal = name not in STRUCTURAL_NAMES and PERSONAL_KEY.search(name.replace("-", "_"))
    return bool(SENSITIVE_KEY.search(key) or personal or PAYMENT_KEY.search(name))


@lru_cache(KEYS_HELD)
def _names_id(key: str) -> bool:
    return bool(ID_KEY.search(key))


def _walked(request: bool, aliased: bool):
    """The function from a JSON text to its parts, the addresses that stand in the holes between them, and where things were taken out. Identifiers are marked in the parts."""
    opaque = re.compile(OPAQUE)
    names = hidden_names(UNSAFE_KEY)

    redactions = [(re.compile(p), by.replace("$1", r"\1"), "@" in p) for p, by in (*values.REDACTIONS, (MAIL, "user@example.com"))]

    def walk(text: str) -> dict:
        holes: list[tuple[str, str]] = []
        gone: list[str] = []
        named: list[dict] = []

        def hole(kind: str, value: str) -> str:
            holes.append((kind, value))
            return f"{MARK}{len(holes) - 1}{END}"

        def note(path: str, into: list, row) -> None:
            if len(into) < PATHS and len(path) <= PATH_CHARS and TOLD_PATH.fullmatch(path):
                into.append(row)

        def rule(key: str | None, path: str, depth: int, value):
            if key and _goes(key) or isinstance(value, str) and is_payment(value):
                note(path, gone, path)
                return "REDACTED"
            if aliased and key and isinstance(value, (str, int)) and _names_id(key) and not isinstance(value, bool) and opaque.fullmatch(str(value)):
                note(path, named, {"path": path, "text": str(value)})
                return hole("ref", str(value))
            if not isinstance(value, str):
                return KEEP
            value = value.replace(MARK, "\ufffd").replace(END, "\ufffd")
            if ADDRESS.match(value):
                return hole("url", value)
            clean = value
            for pattern, by, mail in redactions:
                clean = pattern.sub(by, clean) if not mail or "@" in clean else clean
            if clean != value or key and any(test(key, clean, request) for test in APPROVED):
                return clean
            return "REDACTED"

        out = dumped(rewritten(loaded(text), rule, names))
        parts, addresses = [""], []
        for i, piece in enumerate(HOLE.split(out)):
            parts[-1] += piece
            kind, value = holes[i] if i < len(holes) else ("", "")
            if kind == "ref":
                parts[-1] += f"{MARK}{value}{END}"
            elif kind:
                addresses.append(value)
                parts.append("")
        return {"parts": parts, "addresses": addresses, "gone": gone, "named": named}

    return walk


_WALKED = pa.struct(
    [
        ("parts", pa.list_(pa.string())), ("addresses", pa.list_(pa.string())), ("gone", pa.list_(pa.string())),
        ("named", pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))),
    ]
)
_WALKED_DDL = "struct<parts:array<string>,addresses:array<string>,gone:array<string>,named:array<struct<path:string,text:string>>>"


def _filled(walked: Column) -> Column:
    """A JSON text with its addresses sanitised."""
    def text(address: Column) -> Column:
        clean = F.regexp_replace(values.redacted(sanitised_url(address)), MAIL, "user@example.com")
        return F.replace(F.replace(clean, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    filled = bound(
        F.transform(walked["addresses"], text),
        lambda filled: F.array_join(F.transform(walked["parts"], lambda p, i: F.concat(p, F.coalesce(F.get(filled, i), F.lit("")))), ""),
    )
    return F.when(F.size(walked["addresses"]) == 0, F.get(walked["parts"], F.lit(0))).otherwise(filled)


def sanitised_bodies(df: DataFrame, body: str, content_type: str, request: bool = False, aliased: bool = False, most: int = BODY_CHARS) -> DataFrame:
    """`df` with `body` as struct<value, outcome, gone, named>: what may be kept of it by its content type.

    outcome: `json`, `form`, `html`, `text`, `multipart` (nothing is kept), `truncated` (over `most` characters: no part of a
    body is kept, as its boundaries can't be told) or `malformed` (JSON that does not parse). gone: paths of what was
    taken out of a JSON body; named: paths and values of identifiers (with `aliased`). A null body stays null; a null
    content type is none, and a body that begins like JSON is read as such.
    """
    ship(df.sparkSession)
    kind = F.lower(F.coalesce(F.col(content_type), F.lit("")))
    text = F.col(body)
    is_json = kind.contains("json") | text.rlike(r"^\s*[\[{]")
    outcome = (
        F.when(F.length(text) > most, "truncated").when(kind.contains("multipart/form-data"), "multipart").when(
            kind.contains("application/x-www-form-urlencoded"), "form",
        )
        .when(kind.contains("html"), "html").when(is_json, "json").otherwise("text")
    )
    judged = df.withColumn("_outcome", F.when(text.isNotNull(), outcome))
    walk = each_text(_walked(request, aliased), _WALKED, _WALKED_DDL)
    walked = judged.withColumn("_walked", walk(F.when(F.col("_outcome") == "json", text)))
    bad = (F.col("_outcome") == "json") & F.col("_walked").isNull()
    value = (
        F.when(F.col("_outcome") == "truncated", TRUNCATED).when(F.col("_outcome") == "multipart", MULTIPART).when(F.col("_outcome") == "form", form_body(text))
        .when(F.col("_outcome") == "html", html_links(text)).when(
            F.col("_outcome") == "json", F.coalesce(_filled(F.col("_walked")), F.lit(MALFORMED)),
        ).when(F.col("_outcome") == "text", values.redacted(text))
    )
    none = F.array().cast("array<string>")
    named = F.coalesce("_walked.named", F.array().cast("array<struct<path:string,text:string>>"))
    out = F.struct(
        value.alias("value"), F.when(bad, "malformed").otherwise(F.col("_outcome")).alias("outcome"), F.coalesce("_walked.gone", none).alias("gone"),
        named.alias("named"),
    )
    return walked.withColumn(body, F.when(text.isNotNull(), out)).drop("_outcome", "_walked")


def captured(df: DataFrame, session: str, order: Sequence[str], url: str, body: str, content_type: str, most: int = BODY_CHARS) -> DataFrame:
    """(session, order, url, value, outcome, gone, refs): captured responses with identifiers as `ref_n`, the same all over a session.

    References are numbered by first sight in a session: by `order` (unique in it), a body's before its address's. refs has the paths of a
    body's identifiers and their references. Identifiers are never part of a result or of its numbers.
    """
    rows = sanitised_bodies(
        df.select(session, *order, F.col(url).alias("_url"), F.col(body).alias("_body"), F.col(content_type).alias("_type")), "_body", "_type",
        aliased=True, most=most,
    )
    rows = written(rows.withColumn("_url", sanitised_url(F.col("_url"), aliased=True)), "captures")
    marked = F.array_distinct(
        F.regexp_extract_all(
            F.concat(F.coalesce(F.col("_body.value"), F.lit("")), F.coalesce("_url", F.lit(""))), F.lit(f"{MARK}([^{END}]*){END}"), F.lit(1),
        ),
    )
    seen = rows.select(session, *order, F.posexplode(marked).alias("_place", "_text"))
    first = seen.groupBy(session, "_text").agg(F.min(F.struct(*order, "_place")).alias("_at"))
    names = numbered(first, [session], [F.asc("_at")], "_number").select(
        F.col(session).alias("_s"), "_text", F.concat(F.lit("ref_"), F.col("_number").cast("string")).alias("_ref"),
    )
    used = seen.select(session, *order, F.col("_text").alias("_t"))
    told = used.join(names, F.col(session).eqNullSafe(F.col("_s")) & (F.col("_t") == F.col("_text")))
    by_row = told.groupBy(session, *order).agg(F.map_from_entries(F.collect_set(F.struct("_text", "_ref"))).alias("_refs"))
    keys = [session, *order]
    right = by_row.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_refs")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    joined = rows.join(right, same, "left")

    def put(c: Column, around: str) -> Column:
        pieces = F.split(c, f"[{MARK}{END}]", -1)
        return F.array_join(
            F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.concat(F.lit(around), F.try_element_at("_refs", p), F.lit(around)))),
            "",
        )

    refs = F.transform("_body.named", lambda n: F.concat(n["path"], F.lit("="), F.try_element_at("_refs", n["text"])))
    return joined.select(
        *keys, put(F.col("_url"), "__").alias("url"), put(F.col("_body.value"), "").alias("value"), F.col("_body.outcome").alias("outcome"),
        F.col("_body.gone").alias("gone"), F.coalesce(refs, F.array().cast("array<string>")).alias("refs"),
    )
