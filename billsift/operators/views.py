"""State tables and views: delivery journal, lifecycle, candidates, coverage, run roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from .numbering import numbered, written

JOURNAL_CAP, CANDIDATES, MAX_ORIGINS, CAPTURES, CAPTURE_CHARS, SLOWEST = 500, 3, 8, 12, 768_000, 8
# The families of places that a search may look at, and failures that concern one candidate alone.
FAMILIES = (
    "exact_entry", "observed_navigation", "tenant_contextual_route", "common_billing_route", "observed_network", "embedded_data", "document_provider",
    "semantic_download",
)
LOCAL_CODES = (
    "document_invalid", "retrieval_incomplete", "recipe_incompatible", "unstable_action_identity", "document_action_ambiguous",
    "browser_download_unsupported", "document_action_side_effect", "document_action_timeout", "unknown",
)


def valid_journal(rows: DataFrame) -> DataFrame:
    """The journal's rows that can be read: a 64-digit identity, a destination, a path, a known status and a time."""
    return rows.where(
        F.col("identity").rlike("^[0-9a-f]{64}$") & F.col("destination").isNotNull() & F.col("path").isNotNull() & F.col("status").isin("pending", "committed") & F.col("updated").isNotNull()
    )


ENTRY = ("identity", "source", "destination", "path", "status", "updated")


def delivery_changes(journal: DataFrame, new: DataFrame, owner: str, cap: int = JOURNAL_CAP) -> DataFrame:
    """What a batch of deliveries (owner, identity, source, destination, path, updated) does to the journal, a row each: ENTRY and `outcome`.

    `again`: the entry has the same destination, its path and state are used again; `refused:supplier`: it does, but is another
    supplier's, and stays as it is. All others are `fresh` and pending, in place of an entry for another destination. An owner keeps
    `cap` entries: the oldest committed ones that the batch does not use are `evicted`, and if these are too few, the newest
    of the fresh are `refused:full`. Identities are unique to an owner, in the journal and in the batch.
    The result is a table of the shared folder; what it is made of is computed once, and nothing is ranked if no owner is over `cap`.
    """
    old = journal.select(F.col(owner).alias("_o"), *[F.col(c).alias(f"_{c}") for c in ENTRY])
    mine = F.col(owner).eqNullSafe(F.col("_o")) & (F.col("identity") == F.col("_identity"))
    same = F.coalesce(F.col("destination") == F.col("_destination"), F.lit(False))
    other = F.coalesce(F.col("_source") != F.col("source"), F.lit(False))
    met = new.join(old, mine, "left").withColumn("outcome", F.when(same & other, "refused:supplier").when(same, "again").otherwise("fresh"))
    told = written(met.select(
        owner, "identity", "source", "destination", F.when(F.col("outcome") == "again", F.col("_path")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("outcome") == "again", F.col("_status")).when(F.col("outcome") == "fresh", "pending").alias("status"),
        F.when(F.col("outcome") == "again", F.col("_updated")).otherwise(F.col("updated")).alias("updated"), "outcome",
    ), "told")
    used = told.where("outcome IN ('again', 'fresh')").select(F.col(owner).alias("_o"), F.col("identity").alias("_identity"))
    kept = journal.join(used, mine, "left_anti").select(owner, *ENTRY, F.lit("kept").alias("outcome"))
    has = lambda what: F.count(F.when(what, 1))
    counts = told.unionByName(kept).where("outcome <> 'refused:supplier'").groupBy(F.col(owner).alias("_o")).agg(
        (F.count("*") - cap).alias("_over"), has(F.col("outcome") == "fresh").alias("_fresh"), has(
            (F.col("outcome") == "kept") & (F.col("status") == "committed")
        ).alias("_committed")
    )
    counts = written(counts.where("_over > 0").select(
        "_o", F.least("_over", "_committed").alias("_gone"),
        (F.col("_fresh") - F.greatest(F.lit(0), F.col("_over") - F.col("_committed"))).alias("_room"),
        (F.col("_over") > F.col("_committed")).alias("_full"),
    ), "over")
    if counts.isEmpty():
        return told.select(owner, *ENTRY, "outcome")
    # an owner's committed entries are no more than `cap` in a journal that is kept by this rule; a batch has no such bound, so it is numbered by ranges
    ranked = kept.where("status = 'committed'").join(counts, F.col(owner).eqNullSafe(F.col("_o"))).withColumn(
        "_turn", F.row_number().over(Window.partitionBy(owner).orderBy("updated", "identity")),
    )
    evicted = ranked.where("_turn <= _gone").select(owner, *ENTRY, F.lit("evicted").alias("outcome"))
    turns = numbered(
        told.where("outcome = 'fresh'").join(counts.where("_full"), F.col(owner).eqNullSafe(F.col("_o"))), [owner],
        [F.asc("updated"), F.asc("identity")], "_turn",
    )
    late = turns.where("_turn > _room").select(F.col(owner).alias("_o"), F.col("identity").alias("_identity"), F.lit(True).alias("_late"))
    full = F.coalesce(F.col("_late"), F.lit(False)) & (F.col("outcome") == "fresh")
    told = told.join(late, mine, "left").withColumns(
        {"outcome": F.when(full, "refused:full").otherwise(F.col("outcome")), "status": F.when(~full, F.col("status"))}
    )
    return written(told.select(owner, *ENTRY, "outcome").unionByName(evicted), "changes")


def prepare_deliveries(journal: DataFrame, new: DataFrame, owner: str, cap: int = JOURNAL_CAP) -> tuple[DataFrame, DataFrame]:
    """(journal, refused) after `new` has been prepared by `delivery_changes`; a fresh entry that finds no room leaves what was there."""
    changes = delivery_changes(journal, new, owner, cap)
    done = changes.where("outcome NOT LIKE 'refused:%'")
    gone = done.select(F.col(owner).alias("_o"), F.col("identity").alias("_identity"))
    kept = journal.join(gone, F.col(owner).eqNullSafe(F.col("_o")) & (F.col("identity") == F.col("_identity")), "left_anti")
    out = kept.select(owner, *ENTRY).unionByName(done.where("outcome <> 'evicted'").select(owner, *ENTRY))
    return out, changes.where("outcome LIKE 'refused:%'").select(owner, "identity", F.substring("outcome", 9, 20).alias("why"))


def commit_deliveries(journal: DataFrame, done: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(journal, conflicts) with `done` (owner, identity, destination, path, updated) committed where destination and path are still the same.

    What is no longer in the journal (`missing`) or there for another destination or path (`changed`) is a conflict, and changes nothing.
    """
    mine = done.select(
        F.col(owner).alias("_o"), F.col("identity").alias("_i"), F.col("destination").alias("_d"), F.col("path").alias("_p"),
        F.col("updated").alias("_u"),
    )
    here = F.col(owner).eqNullSafe(F.col("_o")) & (F.col("identity") == F.col("_i"))
    same = F.coalesce((F.col("destination") == F.col("_d")) & (F.col("path") == F.col("_p")), F.lit(False))
    out = journal.join(mine, here, "left").withColumns(
        {"status": F.when(same, "committed").otherwise(F.col("status")), "updated": F.when(same, F.col("_u")).otherwise(F.col("updated"))}
    ).drop("_o", "_i", "_d", "_p", "_u")
    met = mine.join(journal.select(owner, "identity", "destination", "path"), here, "left")
    conflicts = met.where(~same).select(
        F.col("_o").alias(owner), F.col("_i").alias("identity"), F.when(F.col("identity").isNull(), "missing").otherwise("changed").alias("why"),
    )
    return out, conflicts


def clear_journal(journal: DataFrame, source: str) -> DataFrame:
    """The journal without a supplier's entries, and without those of no supplier."""
    return journal.where(F.col("source").isNotNull() & (F.col("source") != source))


def is_fresh(verified: Column, review: Column, now: Column, days: int = 90) -> Column:
    """Whether a verification is not in the future, not over `days` old, and its review is not due."""
    return F.coalesce((verified <= now) & (F.unix_micros(now) - F.unix_micros(verified) <= days * 86_400_000_000) & (review >= now), F.lit(False))


def is_runnable(stage: Column, health: Column, complete: Column, fresh: Column) -> Column:
    """Whether a supplier's recipe may run: a pilot unless its health holds it, a supported one if healthy, fully attested and fresh."""
    return F.when(
        stage == "pilot", health.isin("needs_verification", "healthy", "verification_stale"),
    ).otherwise((stage == "supported") & (health == "healthy") & complete & fresh)


def lifecycle_label(stage: Column, health: Column, verified: Column, fresh: Column) -> Column:
    reason = F.replace(health, F.lit("_"), F.lit(" "))
    runs = health.isin("needs_verification", "healthy", "verification_stale")
    return (
        F.when(stage == "retired", "Retired").when(stage == "experimental", "Experimental").when(stage == "degraded", F.concat(F.lit("Degraded: "), reason))
        .when((stage == "pilot") & ~runs, F.concat(F.lit("Pilot: "), reason)).when(
            (stage == "pilot") & (health == "healthy") & fresh, "Pilot: live verified",
        ).when(stage == "pilot", "Pilot: bundled recipe")
        .when(verified.isNull(), "Supported: verification needed").when(~fresh, "Supported: verification stale").otherwise("Supported: live verified")
    )


def candidate_set(
    ranked: DataFrame, keys: Sequence[str], order: Sequence[str], key: str, origins: str, most: int = CANDIDATES, most_origins: int = MAX_ORIGINS,
) -> DataFrame:
    """(keys, key, place): candidates in order that are kept: each key once, `most` at most, and none that would bring the origins of all kept over `most_origins`.

    A candidate that brings too many is skipped, and later ones may still fit, so it is a fold; only the first row of each
    key is folded, as others are never kept once it is met, and a rejected one brings the same origins again.
    """
    first = ranked.groupBy(*keys, key).agg(F.min(F.struct(*order, F.array_distinct(origins).alias("_o"))).alias("_c"))
    kept = folds.folded(
        first, keys, [*[F.col(f"_c.{o}") for o in order], F.col(key)], [F.col(key).cast("string"), F.col("_c._o")],
        lambda: folds.Chosen(most, most_origins), f"`{key}` string, place int",
    )
    return kept.select(*keys, "place", key)


def first_working(attempts: DataFrame, keys: Sequence[str], place: str, status: Column, code: Column, documents: Column) -> DataFrame:
    """(keys, kind, attempted): how a walk over ranked candidates ends: the first proven delivery is a success, the first failure that is not the candidate's own is fatal, else all are exhausted."""
    ran = status.isin("ok", "partial")
    proven = ran & (documents > 0) & F.coalesce(code != "retrieval_incomplete", F.lit(True))
    known = code.isNull() | code.isin(*LOCAL_CODES)
    local = ~status.isin("auth_expired", "rate_limited", "skipped") & known
    kind = F.when(proven, "success").when(~local, "fatal")
    told = attempts.select(*keys, F.col(place).alias("_p"), kind.alias("_kind"))
    ends = told.groupBy(*keys).agg(F.min(F.when(F.col("_kind").isNotNull(), F.struct("_p", "_kind"))).alias("_e"), F.count("*").alias("_n"))
    return ends.select(*keys, F.coalesce("_e._kind", F.lit("exhausted")).alias("kind"), F.coalesce(F.col("_e._p").cast("long"), F.col("_n")).alias("attempted"))


def family_coverage(attempts: DataFrame, keys: Sequence[str], family: str, exhausted: Column) -> DataFrame:
    """(keys, attempted, exhausted, unavailable): families by name; the last two are empty while a frontier is left."""
    all_ = F.array(*map(F.lit, FAMILIES))
    met = attempts.groupBy(*keys).agg(F.collect_set(F.when(F.col(family).isin(*FAMILIES), F.col(family))).alias("_met"), F.bool_and(exhausted).alias("_done"))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return met.select(
        *keys, joined(F.col("_met")).alias("attempted"),
        F.when(F.col("_done"), joined(F.array_intersect(all_, "_met"))).otherwise("").alias("exhausted"),
        F.when(F.col("_done"), joined(F.array_except(all_, "_met"))).otherwise("").alias("unavailable"),
    )


def scope_summary(scopes: DataFrame, keys: Sequence[str], status: str, code: str) -> DataFrame:
    """(keys, total, succeeded, empty, failed, codes): how a run's scopes ended, and the different codes of failures."""
    count = lambda s: F.count_if(F.col(status) == s).alias(s)
    return scopes.groupBy(*keys).agg(
        F.count("*").alias("total"), count("succeeded"), count("empty"), count("failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col(status) == "failed", F.col(code)))), ",").alias("codes"),
    )


def run_rollup(runs: DataFrame, keys: Sequence[str], place: str, status: str, count: str) -> DataFrame:
    """(keys, collected, attention, kind, first): invoices of runs that went well or partly, how many need attention, and the first run of the gravest kind: collected, waiting, expired, failed, partial or none."""
    s = F.col(status)
    first = lambda *names: F.min(F.when(s.isin(*names), F.col(place)))
    out = runs.groupBy(*keys).agg(
        F.sum(F.when(s.isin("ok", "partial"), F.col(count)).otherwise(0)).alias("collected"), F.count_if(~s.isin("ok", "partial")).alias("attention"),
        first("rate_limited", "skipped").alias("_w"), first("auth_expired").alias("_x"), first("error").alias("_f"), first("partial").alias("_p"),
    )
    ways = (("waiting", "_w"), ("expired", "_x"), ("failed", "_f"), ("partial", "_p"))
    kind, at = F.when(F.col("collected") > 0, "collected"), F.when(F.col("collected") > 0, F.lit(None))
    for name, c in ways:
        kind, at = kind.when(F.col(c).isNotNull(), name), at.when(F.col(c).isNotNull(), F.col(c))
    return out.select(*keys, "collected", "attention", kind.otherwise("none").alias("kind"), at.alias("first"))


def retry_snapshot(connections: DataFrame, keys: Sequence[str], at: str, now: Column, ahead: Column) -> DataFrame:
    """(keys, due, next): how many connections may be tried again now, and when the next one may, within `ahead`."""
    c = F.col(at)
    return connections.groupBy(*keys).agg(F.count_if((c > 0) & (c <= now)).alias("due"), F.min(F.when((c > now) & (c <= now + ahead), c)).alias("next"))


def catch_up_due(connections: DataFrame, keys: Sequence[str], last: Column, now: Column, gap: Column) -> DataFrame:
    """(keys, due): whether any connection was last tried a whole gap ago."""
    return connections.groupBy(*keys).agg(F.coalesce(F.bool_or(now - last >= gap), F.lit(False)).alias("due"))


def capture_buffer(captures: DataFrame, keys: Sequence[str], pos: str, request: str, size: str, most: int = CAPTURES, chars: int = CAPTURE_CHARS) -> DataFrame:
    """(keys, pos): the captures that a buffer holds in the end.

    One that comes in takes the place of an older one of the same request, then pushes out the oldest until `most` are left
    and their sizes add up to `chars` at most; one over `chars` never comes in. What was pushed out by one that is replaced
    later stays out, so it is a fold in order, whose state has `most` entries.
    """
    fit = captures.where(F.col(size) <= chars)
    kind = dict(fit.dtypes)[pos]
    return folds.folded(
        fit, keys, [F.col(pos)], [F.col(pos), F.xxhash64(request), F.col(size).cast("long")], lambda: folds.Buffered(most, chars), f"`{pos}` {kind}",
    )


def suppliers_by_destination(suppliers: DataFrame, destination: str, name: str) -> DataFrame:
    """(destination, n, names): how many suppliers deliver to each destination, and their names in order."""
    return suppliers.groupBy(destination).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))
