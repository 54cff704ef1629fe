"""Rules of a search for a supplier's documents: proof, budgets, checkpoints, states, wakes, and what may be kept of what it saw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import policy, urls

# Budgets (pages, depth, milliseconds, slices), times that a state is kept (seconds), moves between states, and shapes.
BUDGETS = {"fast": (40, 4, 60_000, 1), "deep": (60, 5, 120_000, 1), "self_heal": (80, 5, 180_000, 5)}
KEPT = {"complete": 45, "failed": 24 * 3600}
ACTIVE = 15 * 60
MOVES = {
    "scan": (("awaiting_permission", "scanning"), "scanning"), "checkpoint": (("scanning",), "scanning"), "preview": (("scanning",), "preview"),
    "connect": (("preview",), "confirming"), "restore": (("confirming",), "preview"), "complete": (("confirming",), "complete"),
}
STRUCTURED, STRONG, CANDIDATES = ("network-json", "embedded-json"), 200, 3
RUN_LEASE_S = 600
TRIGGERS, STATUSES = ("connect", "manual", "scheduled"), ("ok", "partial", "auth_expired", "rate_limited", "error")
COUNTS = ("accepted", "verified", "documentActions", "pageOwnedDownloads", "failedScopes", "emptyScopes")
MAX_COUNT, MAX_ELAPSED_MS = 100_000, 3_600_000
CREDENTIAL_KEY = r"(?i)(?:^|[_-])(?:token|secret|password|passwd|passcode|credential|private[_-]?key|privatekey|cookie|session|authorization|apikey|api[_-]?key|csrf|xsrf|signature|jwt|otp|mfa)(?:[_-]|$)"
CREDENTIAL_VALUE = r"(?i)^(?:eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|(?:sk|pk|rk|api)[_-](?:live|test|prod)[_-][A-Za-z0-9_-]{8,}|(?:bearer|basic)\s+\S{8,})$"
CONTENT_TYPE = r"^[a-z0-9][a-z0-9!#$&^_.+-]{0,62}/[a-z0-9][a-z0-9!#$&^_.+-]{0,62}$"
TEMPLATE = r"(\{[A-Za-z_][A-Za-z0-9_]*\})"
NOTE_REFUSED = r"(?i)https?:|www\.|@|\b(?:bearer|token|secret|password)\b|\d{8,}"


def proof_suffices(adapters: Column, entry_read: Column, waves: Column) -> Column:
    """Whether a search may stop: structured data proves at once, links once the entry page has been read, anything else after a wave more."""
    structured = F.arrays_overlap(adapters, F.array(*map(F.lit, STRUCTURED)))
    return structured | (entry_read & (F.array_contains(adapters, "dom-links") | ((F.size(adapters) > 0) & (waves >= 1))))


def enough_strong(scores: Column) -> Column:
    """Whether the candidates kept are as many as can be and all rest on structured evidence."""
    return (F.size(scores) >= CANDIDATES) & F.forall(scores, lambda s: s >= STRONG)


def _budget(mode: Column, place: int) -> Column:
    return F.coalesce(*[F.when(mode == m, F.lit(b[place])) for m, b in BUDGETS.items()])


def checkpoint(mode: Column, pages: Column, linked: Column, common: Column, elapsed_ms: Column, slices: Column) -> Column:
    """Counters of a search held within the budget of its mode, and whether they already were: struct<pages,linked,common,elapsed_ms,slices,valid>; null for an unknown mode."""
    within = lambda c, most: F.greatest(F.lit(0), F.least(most, c)).cast("long")
    kept = within(pages, _budget(mode, 0))
    kept_linked = within(linked, kept)
    kept_common = within(common, kept - kept_linked)
    kept_ms, kept_slices = within(elapsed_ms, _budget(mode, 2)), within(slices, _budget(mode, 3))
    same = (kept == pages) & (kept_linked == linked) & (kept_common == common) & (kept_ms == elapsed_ms) & (kept_slices == slices)
    out = F.struct(
        kept.alias("pages"), kept_linked.alias("linked"), kept_common.alias("common"), kept_ms.alias("elapsed_ms"), kept_slices.alias("slices"),
        F.coalesce(same, F.lit(False)).alias("valid"),
    )
    return F.when(mode.isin(*BUDGETS), out)


def resumable(frontier: Column) -> Column:
    """The targets of array<struct<key,route,source,hint>> that a deeper search may go on with: those found, not guessed."""
    return F.filter(
        frontier,
        lambda t: t["route"].isNotNull() & t["source"].isNotNull() & (t["source"] != "common_route") & (F.coalesce(t["hint"], F.lit("")) != "common_fallback"),
    )


def continued_mode(mode: Column, frontier: Column) -> Column:
    """`deep` for a fast search that has targets left to go on with; else null."""
    return F.when((mode == "fast") & (F.size(resumable(frontier)) > 0), "deep")


def state_at(stage: Column, updated: Column, now: Column) -> Column:
    """A search's stage at `now`; `idle` once it has been kept for its time."""
    ttl = F.coalesce(*[F.when(stage == s, F.lit(t)) for s, t in KEPT.items()], F.lit(ACTIVE))
    return F.when(
        stage.isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp")) > ttl.cast("long") * 1_000_000), "idle",
    ).otherwise(stage)


def moved(stage: Column, move: Column, same_run: Column, limit_reached: Column) -> Column:
    """The stage after a move, null where the move is not open to it.

    `begin` and `clear` are always open. All others, but for `scan` and `continue`, need the run that is stored. `fail` ends a scan, or sends a
    confirmation that fails there too; `continue` takes up a failed search that had reached its limit.
    """
    steps = [F.when((move == m) & stage.isin(*froms) & (same_run | (move == "scan")), F.lit(to)) for m, (froms, to) in MOVES.items()]
    return F.coalesce(
        F.when(move == "begin", "awaiting_permission"), F.when(move == "clear", "idle"), *steps,
        F.when(
            (move == "fail") & stage.isin("scanning", "confirming") & same_run, "failed",
        ), F.when((move == "continue") & (stage == "failed") & limit_reached, "scanning"),
    )


def wake(off: Column, next_at: Column, lease_until: Column, lease_full: Column, retry_due: Column, now: Column) -> Column:
    """What a scheduled wake does: struct<claimed, full, lease_until>.

    A lease that has run out is given up, and if it was for a full sweep, that is due again. Nothing is claimed while a run
    holds its lease, while the schedule is off, or if neither a full sweep nor a retry is due. A claim is held for RUN_LEASE_S.
    """
    expired = F.coalesce(lease_until <= now, F.lit(False))
    held = lease_until.isNotNull() & ~expired
    due = F.when(expired & F.coalesce(lease_full, F.lit(False)), F.lit(True)).otherwise(next_at.isNull() | (next_at <= now))
    claimed = ~off & ~held & (due | retry_due)
    until = F.when(claimed, now + F.expr(f"INTERVAL {RUN_LEASE_S} SECONDS")).when(held & ~off, lease_until)
    return F.struct(claimed.alias("claimed"), (claimed & due).alias("full"), until.alias("lease_until"))


def destination_state(kind: Column, folder: Column, date_mode: Column, company: Column, name: Column, reason: Column) -> Column:
    """A stored destination's kind, or `unavailable:` and why it can't be used. `kind` is filesystem, company or unavailable."""
    root = F.trim(folder)
    named = lambda c: F.coalesce((F.trim(c) != "") & (F.length(c) <= 200), F.lit(False))
    on_disk = named(root) & (policy.folder_path(root) != "") & date_mode.isin("extraction", "invoice")
    return (
        F.when((kind == "filesystem") & F.coalesce(on_disk, F.lit(False)), "filesystem").when((kind == "company") & named(company) & named(name), "company")
        .when((kind == "unavailable") & (reason == "connection_expired"), "unavailable:connection_expired").otherwise("unavailable:invalid_stored_destination")
    )


def feedback_note(note: Column) -> Column:
    """struct<note, refused>: a note with single blanks; refused if over 500 characters, or with links, addresses, account numbers or credentials."""
    text = F.nullif(F.trim(F.regexp_replace(F.trim(note), r"\s+", " ")), F.lit(""))
    refused = F.coalesce((F.length(text) > 500) | text.rlike(NOTE_REFUSED), F.lit(False))
    return F.struct(F.when(~refused, text).alias("note"), refused.alias("refused"))


def is_safe_template_path(url: Column) -> Column:
    """Whether the templates in a path stand for tenants alone: a whole segment behind a tenant's container, with no secret's name in or next to it."""
    path = F.try_url_decode(F.replace(urls.path_of(url), F.lit("+"), F.lit("%2B")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def good(s: Column, i: Column) -> Column:
        names = F.transform(F.regexp_extract_all(s, F.lit(TEMPLATE), F.lit(1)), lambda t: F.substring(t, 2, F.length(t) - 2))
        before, after = F.coalesce(F.get(segments, i - 1), F.lit("")), F.coalesce(F.get(segments, i + 1), F.lit(""))
        secret = policy.is_secret_name(s) | policy.is_secret_name(before) | policy.is_secret_name(after) | F.exists(names, policy.is_secret_name)
        return (F.size(names) == 0) | (~secret & s.rlike(f"^{TEMPLATE}$") & before.rlike(policy.TENANT_CONTAINER))

    return F.coalesce(F.forall(F.transform(segments, good), lambda ok: ok), F.lit(False))


def request_auth(headers: Column) -> Column:
    """struct<scheme, header> of array<struct<name,value>>: the first bearer or basic header, else the first custom one, else none. 100 headers count."""
    marks = F.transform(
        F.slice(headers, 1, 100),
        lambda h: F.struct(policy.header_marker(h["name"], F.substring(h["value"], 1, 8192)).alias("scheme"), F.lower(h["name"]).alias("header")),
    )
    strong, weak = (F.get(F.filter(marks, lambda m: m["scheme"].isin(*kinds)), F.lit(0)) for kinds in (("bearer", "basic"), ("custom",)))
    return F.coalesce(strong, weak, F.struct(F.lit("none").alias("scheme"), F.lit(None).cast("string").alias("header")))


def kept_headers(headers: Column) -> Column:
    """What may be kept of request headers: a well-formed content type, without parameters; null else."""
    kind = lambda h: F.lower(F.trim(F.split_part(h["value"], F.lit(";"), F.lit(1))))
    named = F.filter(F.slice(headers, 1, 100), lambda h: (F.lower(h["name"]) == "content-type") & (F.length(h["value"]) <= 8192) & kind(h).rlike(CONTENT_TYPE))
    return F.try_element_at(F.transform(named, kind), F.lit(-1))


def unbound_redaction(url: Column) -> Column:
    """Whether an address has a part that was redacted, so that it can't be asked for again."""
    return url.rlike("(?:^|[?&=:/])REDACTED(?:$|[?&=/])")


def replayable_url(url: Column) -> Column:
    """An address without user data and hash, the values of its credential-like keys (by name or value) redacted; ordinary keys stay."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")
    value = lambda kv: F.coalesce(F.try_url_decode(F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1)), F.lit(""))
    key = lambda kv: F.regexp_extract(kv, "^([^=]*)", 1)
    secret = lambda kv: key(kv).rlike(CREDENTIAL_KEY) | F.trim(value(kv)).rlike(CREDENTIAL_VALUE)
    clean = F.array_join(
        F.transform(F.split(urls.query_of(bare), "&"), lambda kv: F.when(secret(kv), F.concat(key(kv), F.lit("=REDACTED"))).otherwise(kv)), "&",
    )
    return F.when(bare.contains("?"), F.concat(F.regexp_extract(bare, r"^([^?]*)", 1), F.lit("?"), clean)).otherwise(bare)


def envelope(item: Column) -> Column:
    """The wrapper that rows of a list (variant) are in, judged by its first: `node.`, `attributes.` or none (empty)."""
    held = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")).rlike("^(?:OBJECT|ARRAY)"), F.lit(False))
    return F.when(held("node"), "node.").when(held("attributes"), "attributes.").otherwise("")


def unwrapped(item: Column, prefix: Column) -> Column:
    """A row out of its wrapper; itself where it has none."""
    inside = F.when(prefix == "node.", F.try_variant_get(item, "$.node", "variant")).when(
        prefix == "attributes.", F.try_variant_get(item, "$.attributes", "variant"),
    )
    return F.coalesce(inside, item)


def is_run_record(body: Column) -> Column:
    """Whether a JSON text is a readable record of a run: a known trigger and status, a bounded time, all six counts whole and bounded."""
    v = F.try_parse_json(body)
    text = lambda path: F.try_variant_get(v, path, "string")
    def whole(path: str, most: int) -> Column:
        number = F.try_variant_get(v, path, "double")
        return F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(?:BIGINT|DECIMAL|DOUBLE)") & (number == F.floor(number)) & number.between(0, most)
    ok = text("$.trigger").isin(*TRIGGERS) & text("$.status").isin(*STATUSES) & whole("$.elapsedMs", MAX_ELAPSED_MS)
    for name in COUNTS:
        ok = ok & whole(f"$.counts.{name}", MAX_COUNT)
    return F.coalesce(ok, F.lit(False))
