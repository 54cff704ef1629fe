"""What JSON bodies and pages hold at any depth: strings with their paths, addresses of documents, redacted copies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exploration, urls
from ..session import ship
from .scans import absolute

DEPTH, NODES, CHILDREN, PATH, LONGEST, SCRIPTS, SCRIPT_CHARS, ROUTES, HINTS = 8, 2000, 200, 320, 2048, 20, 256_000, 80, 20
# Names of fields that hold addresses, words of links to documents, and what a redacted body may not show.
ROUTE_KEY = r"(?i)(?:invoice|receipt|statement|billing|document|download|pdf|url|href|route)"
DOCUMENT_FIELD = r"(?i)(?:^|[._-])(?:(?:invoice|receipt|statement|document)[_-]?(?:pdf|url)|pdf[_-]?url|download[_-]?url)$"
LINK_HINT = r"(?i)receipt|invoice|\.pdf(\?|$)|/download"
LINK_TOKENS = ("receipt", "invoice", "billing", "download", ".pdf")
DATA_SCRIPT = r"""(?is)<script\b[^>]*\btype=["']application/(?:ld\+)?json["'][^>]*>(.*?)</script\s*>"""
HREF = r'(?i)\bhref="([^"]+)"'
PII_KEY = re.compile(r"email|name|recipient|address|phone|vat|tax|ssn|personnummer|customer", re.I)
SENSITIVE_KEY = re.compile(r"token|secret|password|passwd|passcode|credential|private[_-]?key|cookie|session|authorization|api[_-]?key|csrf|xsrf", re.I)
PAYMENT_KEY = re.compile(
    r"(?:^|_)(?:card(?:_?(?:number|pan|cvc|cvv|security_?code))?|cvv|cvc|iban|bic|swift|bank(?:_?(?:account|number|routing|code))?|routing(?:_?number)?|account_?number|sort_?code)(?:_|$)",
    re.I,
)
EMAIL, LONG_TOKEN = re.compile(r"(?<![^\s@])[^\s@]+@[^\s@]+\.[^\s@]+"), re.compile(r"[A-Za-z0-9_-]{24,}")
UNSAFE_KEY = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+\Z|[A-Za-z0-9_-]{24,}\Z|(?:sk|pk|rk|api)_(?:live|test|prod)_", re.I)
SURROGATE = re.compile("[\ud800-\udfff]")
CARD, IBAN = re.compile(r"\b(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})\b", re.A), re.compile(r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b", re.I | re.A)
CREDENTIAL_KEY, CREDENTIAL_VALUE = re.compile(exploration.CREDENTIAL_KEY), re.compile(exploration.CREDENTIAL_VALUE)
#: A card or account number has 13 characters at least; what is said of so many names of members is kept by a worker.
LEAST_PAYMENT, KEYS_HELD = 13, 4096
RECORDED_PATHS, REDACTED_DEPTH, BODY_CHARS = 40, 12, 256_000


def _strings(root) -> list[tuple[str, bool, str]]:
    """(path, typed, text) of a JSON value's strings, upper levels first; `typed` below an object whose @type names a document."""
    found, left, level = [], NODES, [(root, "", False)]
    for _ in range(DEPTH + 1):
        below = []
        for value, path, typed in level[:left]:
            if isinstance(value, str):
                found.append((path, typed, value))
            elif isinstance(value, list):
                below += [(x, path, typed) for x in value[:CHILDREN]]
            elif isinstance(value, dict):
                kind = value.get("@type")
                typed = typed or (isinstance(kind, str) and re.search(ROUTE_KEY, kind) is not None)
                below += [(x, f"{path}.{k}"[-PATH:], typed) for k, x in list(value.items())[:CHILDREN]]
        left, level = left - len(level), below
        if left <= 0:
            break
    return found


def _luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def is_payment(text: str) -> bool:
    """Whether a text holds the number of a card or a bank account, by its check digits."""
    if len(text) < LEAST_PAYMENT:
        return False
    if any(_luhn(re.sub(r"\D", "", m)) for m in CARD.findall(text)):
        return True
    for m in IBAN.findall(text):
        iban = re.sub("[ -]", "", m).upper()
        if 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1:
            return True
    return False


@lru_cache(KEYS_HELD)
def policy_key(key: str) -> str:
    return re.sub(r"[-\s]+", "_", re.sub("([a-z0-9])([A-Z])", r"\1_\2", key)).lower()


@lru_cache(KEYS_HELD)
def _of_people(key: str) -> bool:
    """Whether a member's name says that it holds a person's data, a secret or a payment."""
    return bool(PII_KEY.search(key) or SENSITIVE_KEY.search(key) or PAYMENT_KEY.search(policy_key(key)))


@lru_cache(KEYS_HELD)
def _of_credentials(key: str) -> bool:
    """Whether a member's name says that it holds a credential or a payment."""
    return bool(CREDENTIAL_KEY.search(re.sub("([a-z0-9])([A-Z])", r"\1_\2", key)) or PAYMENT_KEY.search(policy_key(key)))


def _number(text: str) -> int | float:
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def _refuse(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_float=_number, parse_constant=_refuse)
_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def loaded(text: str):
    """A JSON text's value; whole numbers are whole however they are written. Raises ValueError on what is no JSON."""
    return _DECODER.decode(text)


def dumped(value) -> str:
    """Compact JSON; halves of characters stay escaped."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", _ENCODER.encode(value))


KEEP = ...  # a single one in every process: what a rule says of a value that stays, or is looked into


def rewritten(value, rule: Callable, names: Callable[[dict], dict[str, str]] = lambda members: {}, key: str | None = None, path: str = "", depth: int = 0):
    """A copy of a JSON value in which each value is what `rule(key, path, depth, value)` makes of it, unless that is KEEP.

    `key` is the nearest member name above; `names` gives new names to an object's members, which paths use.
    """
    made = rule(key, path, depth, value)
    if made is not KEEP:
        return made
    inside = f"{path}." if path else ""
    if isinstance(value, list):
        return [rewritten(x, rule, names, key, f"{inside}{i}", depth + 1) for i, x in enumerate(value)]
    if isinstance(value, dict):
        new = names(value)
        return {new.get(k, k): rewritten(x, rule, names, k, f"{inside}{new.get(k, k)}", depth + 1) for k, x in value.items()}
    return value


@lru_cache(KEYS_HELD)
def _hides(unsafe: re.Pattern, key: str) -> bool:
    return bool(unsafe.match(unquote(key)))


def hidden_names(unsafe: re.Pattern) -> Callable[[dict], dict[str, str]]:
    """Gives the members of an object whose names match `unsafe` numbered names that no other member has."""

    def names(members: dict) -> dict[str, str]:
        out: dict[str, str] = {}
        taken = set(members)
        for i, k in enumerate((k for k in members if _hides(unsafe, k)), 1):
            while (name := f"__redacted_key_{i}__") in taken:
                i += 1
            taken.add(name)
            out[k] = name
        return out

    return names


def _without_people(text: str) -> str:
    """A copy with what names people, secrets or payments taken out; long tokens get numbers by first sight."""
    seen: dict[str, str] = {}

    def rule(key: str | None, path: str, depth: int, value):
        if not isinstance(value, str):
            return KEEP
        if (key and _of_people(key)) or is_payment(value):
            return "REDACTED"
        value = EMAIL.sub("user@example.com", value) if "@" in value else value
        return LONG_TOKEN.sub(lambda m: seen.setdefault(m[0], f"REDACTED_VALUE_{len(seen) + 1}"), value)

    return dumped(rewritten(json.loads(text), rule, hidden_names(UNSAFE_KEY)))


def _without_credentials(text: str) -> dict | None:
    """A copy with its credentials taken out, and where they were."""
    if len(text) > BODY_CHARS:
        return None
    paths: list[str] = []

    def rule(key: str | None, path: str, depth: int, value):
        if depth > REDACTED_DEPTH:
            return None
        secret = key is not None and _of_credentials(key)
        if not secret and not (isinstance(value, str) and (is_payment(value) or CREDENTIAL_VALUE.match(value.strip()))):
            return KEEP
        if len(paths) < RECORDED_PATHS and 0 < len(path) <= 300 and all(re.fullmatch(r"[A-Za-z0-9_$-]+", p) for p in path.split(".")):
            paths.append(path)
        return "REDACTED"

    return {"value": dumped(rewritten(json.loads(text), rule)), "paths": paths}


def _strings_of(text: str) -> list[dict]:
    plain = lambda x: SURROGATE.sub("\ufffd", x)
    return [{"path": plain(p), "typed": t, "text": plain(x)} for p, t, x in _strings(json.loads(text))]


def each_text(make: Callable[[str], object], kind: pa.DataType, ddl: str):
    """An Arrow function of a column of JSON texts; null where a text is null, empty or no JSON."""

    @F.arrow_udf(ddl)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                try:
                    out.append(make(text) if text else None)
                except (ValueError, RecursionError):
                    out.append(None)
            yield pa.array(out, type=kind)

    return run


def json_strings(df: DataFrame, body: str) -> DataFrame:
    """`df` without `body`, with (place, path, typed, text): one row for each string of a JSON body.

    8 levels, 2,000 values and 200 members of each are looked at, upper levels first: these bounds are the feature's.
    """
    ship(df.sparkSession)
    kind = pa.list_(pa.struct([("path", pa.string()), ("typed", pa.bool_()), ("text", pa.string())]))
    run = each_text(_strings_of, kind, "array<struct<path:string,typed:boolean,text:string>>")
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.posexplode(run(body)).alias("place", "_s")).select(*rest, "place", "_s.*")


_SCALAR = pa.struct(
    [
        ("place", pa.int32()), ("turn", pa.int32()), ("path", pa.string()), ("key", pa.string()), ("parent", pa.string()), ("listed", pa.bool_()),
        ("kind", pa.string()), ("value", pa.string()),
    ]
)
_SCALAR_DDL = "array<struct<place:int,turn:int,path:string,key:string,parent:string,listed:boolean,kind:string,value:string>>"


def _turns(root) -> dict[tuple[int, str], int]:
    """For the members of objects that no list is above, the turn in which they are met level by level; NODES values and CHILDREN members of each are looked at."""
    out: dict[tuple[int, str], int] = {}
    level, left = [root], NODES
    for _ in range(DEPTH + 1):
        below = []
        for value in level[:left]:
            if isinstance(value, dict):
                for k, x in list(value.items())[:CHILDREN]:
                    out[id(value), k] = len(out)
                    below.append(x)
        left, level = max(left - len(level), 0), below
    return out


def _scalars_of(text: str) -> list[dict]:
    root = loaded(text)
    turns, out = _turns(root), []
    plain = lambda x: SURROGATE.sub("\ufffd", x)

    def walk(value, path: str, key: str | None, parent: str | None, listed: bool, turn: int | None, depth: int) -> None:
        if depth > DEPTH + 1:
            return
        if isinstance(value, dict):
            for k, x in value.items():
                walk(x, f"{path}.{k}" if path else k, k, key, listed, turns.get((id(value), k)), depth + 1)
        elif isinstance(value, list):
            for i, x in enumerate(value):
                walk(x, f"{path}.{i}" if path else str(i), key, parent, True, None, depth + 1)
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
            told = None if value is None else plain(value) if isinstance(value, str) else json.dumps(value)
            out.append(
                {
                    "place": len(out), "turn": turn, "path": plain(path) or "$", "key": key and plain(key), "parent": parent and plain(parent),
                    "listed": listed, "kind": kind, "value": told,
                }
            )

    walk(root, "", None, None, False, None, 0)
    return out


def scalars(df: DataFrame, body: str) -> DataFrame:
    """`df` without `body`, with a row for each scalar of its JSON, nine levels deep: place, turn, path, key, parent, listed, kind, value.

    place is its number in the text; turn that of its member when objects are read level by level (null below a list, or
    beyond 2,000 values or 200 members of one). key is the nearest member name, parent that of the object it is in. `listed`
    is true below a list. A path has members' names and places in lists. What is no JSON has no rows.
    """
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != body]
    found = df.select(*rest, F.explode(each_text(_scalars_of, pa.list_(_SCALAR), _SCALAR_DDL)(body)).alias("_scalar"))
    return found.select(*rest, "_scalar.*")


_FIELD = pa.struct(
    [
        ("list", pa.string()), ("turn", pa.int32()), ("n_items", pa.int32()), ("prefix", pa.string()), ("item", pa.int32()), ("place", pa.int32()),
        ("key", pa.string()), ("kind", pa.string()), ("value", pa.string()),
    ]
)
_FIELD_DDL = "array<struct<list:string,turn:int,n_items:int,prefix:string,item:int,place:int,key:string,kind:string,value:string>>"
LIST_DEPTH = 6
ENVELOPES = ("node", "attributes")


def _fields_of(text: str) -> list[dict]:
    lists: list[tuple[str, list[dict]]] = []

    def find(value, path: str, depth: int) -> None:
        if depth > LIST_DEPTH:
            return
        if isinstance(value, dict):
            for k, x in value.items():
                find(x, f"{path}.{k}" if path else k, depth + 1)
        elif isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
            lists.append((path or "$", value))

    find(loaded(text), "", 0)
    plain = lambda x: SURROGATE.sub("\ufffd", x)
    out = []
    for turn, (path, items) in enumerate(lists):
        inside = next((e for e in ENVELOPES if isinstance(items[0].get(e), (dict, list)) and items[0][e] is not None), None)
        about = {"list": plain(path), "turn": turn, "n_items": len(items), "prefix": f"{inside}." if inside else ""}
        for i, item in enumerate(items):
            row = item.get(inside, item) if inside else item
            row = item if row is None else row
            for place, (k, x) in enumerate(row.items() if isinstance(row, dict) else ()):
                kind = "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number" if isinstance(x, (int, float)) else "other"
                out.append(
                    about | {
                        "item": i, "place": place, "key": plain(k), "kind": kind,
                        "value": plain(x) if kind == "string" else json.dumps(x) if kind in ("number", "boolean") else None,
                    }
                )
    return out


def listed_fields(df: DataFrame, body: str) -> DataFrame:
    """`df` without `body`, with a row for each member of each object of the lists of objects in its JSON: list, turn, n_items, prefix, item, place, key, kind, value.

    Lists are found through objects, six levels deep; turn is a list's number. If a list's first object has a `node` or `attributes`, that is
    the envelope of all (prefix), and members are those inside it. A value that is no scalar is null, of kind `other`. What is no JSON has no rows.
    """
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != body]
    found = df.select(*rest, F.explode(each_text(_fields_of, pa.list_(_FIELD), _FIELD_DDL)(body)).alias("_field"))
    return found.select(*rest, "_field.*")


def document_fields(df: DataFrame, body: str) -> DataFrame:
    """The rows of `json_strings` whose field is named as one that holds a document's address, without `typed`."""
    found = json_strings(df, body)
    return found.where(F.col("path").rlike(DOCUMENT_FIELD) & (F.length("text") <= LONGEST)).drop("typed")


def structured_routes(df: DataFrame, keys: Sequence[str], html: str, base: str, most: int = ROUTES) -> DataFrame:
    """(keys, route, place): routes that a page's data scripts name, by their own field or an object of a document's type; each once, the first `most`.

    The first 20 scripts of up to 256,000 characters are read. A route is an address that `safe_route` keeps.
    """
    scripts = F.slice(F.regexp_extract_all(F.col(html), F.lit(DATA_SCRIPT), F.lit(1)), 1, SCRIPTS)
    bodies = df.select(*keys, F.col(base).alias("_base"), F.posexplode(scripts).alias("_script", "_body")).where(F.length("_body") <= SCRIPT_CHARS)
    found = json_strings(bodies, "_body").where((F.col("typed") | F.col("path").rlike(ROUTE_KEY)) & (F.length("text") <= LONGEST))
    routes = found.select(*keys, "_script", "place", urls.safe_route(absolute(F.col("text"), F.col("_base"))).alias("route")).where("route IS NOT NULL")
    first = routes.groupBy(*keys, "route").agg(F.min(F.struct("_script", "place")).alias("_at"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    return first.withColumn("place", turn - 1).where(F.col("place") < most).select(*keys, "route", "place")


def document_hints(df: DataFrame, keys: Sequence[str], html: str, order: str, most: int = HINTS) -> DataFrame:
    """(keys, link, place): link targets that hint at documents, each once, the first `most` over a key's pages in `order`."""
    links = df.select(*keys, F.col(order).alias("_page"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("_pos", "link"))
    first = links.where(F.col("link").rlike(LINK_HINT)).groupBy(*keys, "link").agg(F.min(F.struct("_page", "_pos")).alias("_at"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    return first.withColumn("place", turn - 1).where(F.col("place") < most).select(*keys, "link", "place")


def link_token(url: Column) -> Column:
    """The folder of a PDF's address, as the part that links to others like it share; null for the root."""
    folder = F.regexp_extract(urls.path_of(url), r"^(.*/)", 1)
    return F.when(F.length(folder) > 1, folder)


def best_link_token(pages: DataFrame, pdfs: DataFrame, keys: Sequence[str], html: str, order: str, url: str = "url") -> DataFrame:
    """(keys, page, token, learned, n_links): the page and token that most distinct links of a key have, one learned from a PDF's address (`pdfs`) before the general ones.

    In a tie the earlier page, then the earlier token stays. Learned tokens are joined by key, never collected.
    """
    general = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(False).alias("learned"), F.lit(i).cast("long").alias("_t")) for i, t in enumerate(LINK_TOKENS)])
    learned = pdfs.select(*keys, link_token(F.col(url)).alias("token"), order).where("token IS NOT NULL").groupBy(*keys, "token").agg(F.min(order).alias("_t"))
    links = pages.select(
        *keys, F.col(order).alias("page"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1)))).alias("_link"),
    )
    by_pdf = links.join(learned, list(keys)).select(*links.columns, "token", F.lit(True).alias("learned"), F.col("_t").cast("long").alias("_t"))
    by_word = links.select("*", F.explode(general).alias("_g")).select(*links.columns, "_g.*")
    matched = by_pdf.unionByName(by_word).where(F.col("_link").contains(F.col("token")))
    counted = matched.groupBy(*keys, "page", "token", "learned", "_t").agg(F.count("*").alias("n_links"))
    order_of = F.struct((~F.col("learned")).alias("a"), (-F.col("n_links")).alias("b"), "page", "_t")
    return counted.groupBy(*keys).agg(F.min_by(F.struct("page", "token", "learned", "n_links"), order_of).alias("_b")).select(*keys, "_b.*")


def fixture(df: DataFrame, body: str) -> DataFrame:
    """`df` with its JSON `body` redacted for a test fixture: shapes, numbers and dates stay; names, secrets and payment data go; null for what is no JSON."""
    ship(df.sparkSession)
    return df.withColumn(body, each_text(_without_people, pa.string(), "string")(body))


def evidence(df: DataFrame, body: str) -> DataFrame:
    """`df` with `body` as struct<value, paths>: its JSON without credentials and payment data, and where these were (40 paths); null for what is no JSON or over 256,000 characters."""
    ship(df.sparkSession)
    kind = pa.struct([("value", pa.string()), ("paths", pa.list_(pa.string()))])
    return df.withColumn(body, each_text(_without_credentials, kind, "struct<value:string,paths:array<string>>")(body))
