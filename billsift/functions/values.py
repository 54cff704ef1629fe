"""Amounts, dates, identities, private data and outcome codes, as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

DECIMAL = r"^-?\d{1,18}(?:\.\d{1,6})?$"
# The retry ladder in seconds, and the outcomes it holds for.
LADDER = (300, 1800, 7200)
TRANSIENT = ("transport_failed", "source_unavailable")
# Causes of failures, the stage they arise in, and the operational code they stand for.
CAUSES = {
    "auth_expired": ("auth", "auth_expired"), "auth_blocked": ("auth", "auth_blocked"), "insufficient_scope": ("auth", "insufficient_scope"),
    "transport_failed": ("list", "transport_failed"), "rate_limited": ("list", "rate_limited"), "unexpected_response": ("list", "recipe_incompatible"),
    "schema_invalid": ("list", "recipe_incompatible"), "selector_miss": ("list", "recipe_incompatible"), "template_invalid": ("document", "recipe_incompatible"),
    "document_invalid": ("document", "document_invalid"), "document_not_found": ("document", "document_invalid"), "document_too_large": ("document", "document_invalid"),
    "retrieval_incomplete": ("list", "retrieval_incomplete"), "destination_unavailable": ("deliver", "destination_unavailable"), "unknown": ("unknown", "unknown"),
}


def identity_key(company: Column, source: Column, id: Column) -> Column:
    """SHA-256 of company, source and id with NUL between."""
    return F.sha2(F.concat_ws("\0", company, source, id), 256)


def content_key(company: Column, source: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\0", company, source, F.lit("pdf-content"), F.sha2(content, 256)), 256)


def origin_id(origin: Column) -> Column:
    """FNV-1a over the characters of an ASCII origin, as seven base-36 digits."""
    start, prime = F.lit(2166136261).cast("long"), F.lit(16777619).cast("long")
    units = F.transform(F.filter(F.split(origin, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    hashed = F.aggregate(units, start, lambda h, c: (h.bitwiseXOR(c) * prime).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lpad(F.lower(F.conv(hashed.cast("string"), 10, 36)), 7, "0")


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    in_range = bound(year.try_cast("int"), lambda y: y.between(2000, 2100))
    return bound(text, lambda t: F.when(in_range & F.try_to_date(t, "yyyy-MM-dd").isNotNull(), t))


# How the names of months begin; a text without one of them is never tried as a date that spells its month.
MONTH = r"(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def displayed_date(c: Column) -> Column:
    """ISO date of ISO, unambiguous day-first or month-first, or month-name text; null otherwise, or outside 2000 to 2100."""
    return bound(c, _displayed_date)


def _displayed_date(c: Column) -> Column:
    iso, mixed = r"(?<![0-9])(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?![0-9])", r"(?<![0-9])(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?![0-9])"
    part = lambda p, i: F.regexp_extract(c, p, i)
    first, second = part(mixed, 1).try_cast("int"), part(mixed, 2).try_cast("int")
    named = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "MMM d yyyy", "MMMM d yyyy")])
    spelt = bound(named, lambda at: F.when(F.year(at).between(2000, 2100), F.date_format(at, "yyyy-MM-dd")))
    return (
        F.when(c.rlike(iso), calendar_date(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(c.rlike(mixed) & (first > 12), calendar_date(part(mixed, 3), part(mixed, 2), part(mixed, 1)))
        .when(c.rlike(mixed) & (second > 12), calendar_date(part(mixed, 3), part(mixed, 1), part(mixed, 2)))
        .when(~c.rlike(mixed) & c.rlike(MONTH), spelt)
    )


def displayed_amount(c: Column) -> Column:
    """A decimal with a point, of an amount as a page shows it; null if the separators leave it open."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?<![A-Za-z])[A-Za-z]{3}(?![A-Za-z])", ""), r"[€£$¥\s ']", "")
    return bound(bare, _plain_amount)


def _plain_amount(bare: Column) -> Column:
    """The decimal of an amount without its currency."""
    comma, dot = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))), F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit("")))
    last_comma, last_dot = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
    both = F.when(
        last_comma < last_dot, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
    ).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    tail = F.regexp_extract(bare, r"[.,](\d*)$", 1)
    single = F.when(F.length(tail) == 3, F.lit(None)).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    many = F.when(bare.rlike(r"^-?\d+(?:[.,]\d{3})+$"), F.regexp_replace(bare, "[.,]", ""))
    number = F.when((comma > 0) & (dot > 0), both).when(comma + dot > 1, many).when(comma + dot == 1, single).otherwise(bare)
    return bound(number, lambda n: F.when(n.rlike(DECIMAL), n))


def currency_of(c: Column) -> Column:
    code = F.upper(F.regexp_extract(c, r"(?<![A-Za-z])([A-Za-z]{3})(?![A-Za-z])", 1))
    return bound(code, lambda x: F.when(x != "", x).when(c.contains("€"), F.lit("EUR")).when(c.contains("£"), F.lit("GBP")))


# What the text redactor replaces, in order.
REDACTIONS = (
    (r"""(?i)(["']?(?:token|secret|password|passwd|cookie|session|authorization|api[_-]?key|csrf|xsrf)["']?\s*[:=]\s*["']?)[^\s,}&"']+""", "$1REDACTED"),
    (r"""(?i)(["']?(?:email|name|recipient|address|phone|vat|tax|ssn|personnummer|customer)["']?\s*[:=]\s*["']?)[^\s,}&"']+""", "$1REDACTED"),
    (r"(?<![A-Za-z0-9_])[Bb]earer\s+[A-Za-z0-9._~+/-]{8,}=*", "Bearer REDACTED"),
    (r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9._-]{20,}", "REDACTED_JWT"),
    (r"(?i)(?<![A-Za-z0-9_])(?:sk|pk|rk|api)[_-](?:live|test|prod)?[_-]?[A-Za-z0-9_-]{12,}(?![A-Za-z0-9_])", "REDACTED_KEY"),
    (r"""(?i)([?&](?:token|key|secret|signature|sig|auth|code)=)[^&#\s"']+""", "$1REDACTED"),
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "user@example.com"),
)
LONG_TOKEN = r"[A-Za-z0-9_-]{24,}"
CARD = r"(?<![A-Za-z0-9_])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![A-Za-z0-9_])"
IBAN = r"(?i)(?<![A-Za-z0-9_])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}(?![A-Za-z0-9_])"


# What a text holds if the redaction of the same place may match; most texts hold none of these.
SIGNS = ("[:=]", "[:=]", "[Bb]earer", "eyJ", "(?i)(?:sk|pk|rk|api)[_-]", "[?&]", "@")


def _replacing(pattern: str, by: str, sign: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x.rlike(sign), F.regexp_replace(x, pattern, by)).otherwise(x)


def redacted(c: Column) -> Column:
    for (pattern, by), sign in zip(REDACTIONS, SIGNS, strict=True):
        c = bound(c, _replacing(pattern, by, sign))
    return c


def aliased_tokens(c: Column) -> Column:
    """Tokens of 24 or more characters as REDACTED_VALUE_n, numbered by first sight in their text."""
    found = F.regexp_extract_all(c, F.lit(f"({LONG_TOKEN})"), F.lit(1))
    pieces = F.split(c, LONG_TOKEN, -1)
    names = F.array_distinct(found)
    marks = F.transform(found, lambda t: F.concat(F.lit("REDACTED_VALUE_"), F.array_position(names, t).cast("string")))
    return F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), marks.alias("m")), lambda x: F.concat(x["p"], F.coalesce(x["m"], F.lit("")))), "")


def card_numbers(c: Column) -> Column:
    """Digits of the card-shaped runs that pass the Luhn check."""
    digits = F.transform(F.regexp_extract_all(c, F.lit(f"({CARD})"), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.filter(digits, lambda d: F.call_function("luhn_check", d))


def ibans(c: Column) -> Column:
    """IBAN-shaped runs whose remainder modulo 97 is one."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({IBAN})"), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, "[ -]", "")))
    moved = lambda x: F.filter(F.split(F.concat(F.substr(x, F.lit(5)), F.substring(x, 1, 4)), ""), lambda d: d != "")
    value = lambda d: F.when(d.rlike(r"\d"), d.cast("int")).otherwise(F.ascii(d) - 55)
    rest = lambda x: F.aggregate(moved(x), F.lit(0), lambda r, d: (r * F.when(d.rlike(r"\d"), 10).otherwise(100) + value(d)) % 97)
    return F.filter(found, lambda x: rest(x) == 1)


def auth_outcome(status: Column, redirected_to_login: Column, matched: Column) -> Column:
    """The first rule that holds decides; order matters."""
    return (
        F.when(status == 0, "transport_failed").when(redirected_to_login, "session_expired").when(status == 401, "session_expired").when(status == 407, "transport_failed")
        .when(status == 403, "insufficient_scope").when(
            status.isin(408, 425) | (status >= 500), "transport_failed",
        ).when(matched, "authenticated").otherwise("blocked_or_challenged")
    )


def retry_delay(code: Column, failures: Column) -> Column:
    """Seconds until the next try after so many failures in a row; null if the outcome is not transient or nothing failed."""
    step = F.least(F.greatest(failures - 1, F.lit(0)), F.lit(2))
    return F.when(code.isin(*TRANSIENT) & (failures > 0), F.element_at(F.array(*map(F.lit, LADDER)), (step + 1).cast("int")))


def rate_limit_until(now: Column, wait_s: Column) -> Column:
    """Epoch seconds when a limited source may be asked again: the wait is held between 5 seconds and 24 hours."""
    return now + F.least(F.greatest(wait_s, F.lit(5)), F.lit(86_400))


def eligible_at(until: Column, now: Column) -> Column:
    """Epoch seconds when a limited source may be asked again, if that is still ahead and no further than a wait can be, with five minutes for clocks that differ; null else."""
    return F.when((until > now) & (until <= now + 86_400 + 300), until)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header (a number or an HTTP date), from 0 to 24 hours; 30 if it can't be read."""
    date = F.regexp_extract(header, r"^\s*[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\s*$", 1)
    at = F.unix_timestamp(F.try_to_timestamp(date, F.lit("dd MMM yyyy HH:mm:ss")))
    seconds = F.coalesce(F.when(header.rlike(r"^\s*\d+\s*$"), F.trim(header).try_cast("long")), at - now, F.lit(30))
    return F.least(F.greatest(seconds, F.lit(0)), F.lit(86_400))


def next_run(mode: str, now: Column, day: int = 1, hour: int = 9) -> Column:
    """The first run strictly after `now` (a timestamp in the session's zone): daily, weekly (`day` 0 is Sunday) or monthly (held to the month's last day)."""
    at = lambda d: F.expr("make_interval(0, 0, 0, 0, {h}, 0, 0)".format(h=hour)) + d.cast("timestamp")
    today = F.to_date(now)
    if mode == "daily":
        return F.when(at(today) > now, at(today)).otherwise(at(F.date_add(today, 1)))
    if mode == "weekly":
        ahead = F.pmod(F.lit(day) - (F.dayofweek(today) - 1), F.lit(7))
        first = at(F.date_add(today, ahead.cast("int")))
        return F.when(first > now, first).otherwise(first + F.expr("INTERVAL 7 DAYS"))
    if mode == "monthly":
        held = lambda d: at(F.date_add(F.trunc(d, "month"), F.least(F.lit(day), F.dayofmonth(F.last_day(d))) - 1))
        return F.when(held(today) > now, held(today)).otherwise(held(F.add_months(F.trunc(today, "month"), 1)))
    raise ValueError(f"unknown mode {mode}")


def path_segment(c: Column) -> Column:
    """A name that is safe as one path segment: control characters go, forbidden ones become dashes, leading dots go."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), r'[\\/:*?"<>|]', "-"), r"^\.+", "")


def save_path(root: Column, vendor: Column, day: Column, name: Column) -> Column:
    """root/vendor/day/name, with every part made safe; a missing day is `undated`."""
    return F.concat_ws("/", *[path_segment(p) for p in (root, vendor, F.coalesce(day, F.lit("undated")), name)])


def locale(c: Column) -> Column:
    """A text that sorts as readers of any language expect: by letter, then accent, then case (the root collation of ICU)."""
    return F.collate(c, "UNICODE")
