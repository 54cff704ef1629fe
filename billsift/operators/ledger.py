"""The ledger of collected invoices: upsert, views, windows of months, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from .numbering import numbered

SEEN_CAP, LEDGER_CAP = 20_000, 1_000
MERGED_VALUES = 32


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], earliest: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """`old` with `new` merged by key: new values win where they are not null.

    `earliest` columns keep the least of both; `lists` are joined without repeats, the first MERGED_VALUES of them.
    """
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    out = []
    for c in old.columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in earliest:
            out.append(F.least(x, y).alias(c))
        elif c in lists:
            empty = F.array().cast(dict(old.dtypes)[c])
            out.append(F.slice(F.array_distinct(F.concat(F.coalesce(x, empty), F.coalesce(y, empty))), 1, MERGED_VALUES).alias(c))
        else:
            out.append((F.coalesce(x, y) if c in keys else F.coalesce(y, x)).alias(c))
    return both.select(*out)


def newest(rows: DataFrame, order: Sequence[Column], cap: int = LEDGER_CAP, keys: Sequence[str] = (), exempt: Column | None = None) -> DataFrame:
    """The first `cap` rows by `order` (of each key): the retention rule of a ledger or seen store. Rows that are `exempt` (reservations) stay beside them."""
    if exempt is not None:
        held = F.coalesce(exempt, F.lit(False))
        return newest(rows.where(~held), order, cap, keys).unionByName(rows.where(held))
    if not keys:
        return rows.orderBy(*order).limit(cap)
    turn = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= cap).drop("_turn")


def by_vendor(entries: DataFrame, vendor: str, name: str, collected: str, amount: str) -> DataFrame:
    """One row for each vendor: the name on its latest entry, when that was, how many entries, and their sum."""
    return entries.groupBy(vendor).agg(
        F.max_by(name, F.struct(collected, name)).alias("vendor_name"), F.max(collected).alias("latest"), F.count("*").alias("n_entries"), F.sum(amount).alias("total")
    )


def in_range(day: Column, today: Column, range: str, collected: Column | None = None, now: Column | None = None) -> Column:
    """Whether a date is within `all`, `30d`, `90d` or `year` up to today; the future is outside of all but `all`. Without a date, when it was collected counts, up to now."""
    if range == "all":
        return F.lit(True)
    start = F.trunc(today, "year") if range == "year" else F.date_sub(today, int(range.rstrip("d")))
    own = day.between(start, today)
    if collected is not None:
        own = F.when(day.isNotNull(), own).otherwise(collected.between(start.cast("timestamp"), now))
    return F.coalesce(own, F.lit(False))


def supplier_groups(entries: DataFrame, vendor: str, name: str, collected: str, issued: str) -> DataFrame:
    """`entries` with `group_place` and `place`: suppliers by their latest entry, then name in locale order; a supplier's entries by their date (when they were collected, without one), then when they were collected, latest first.

    Both places are numbered by ranges, so a supplier with very many entries is not sorted in one task.
    """
    latest = entries.groupBy(vendor).agg(F.max(collected).alias("_latest"), F.max_by(name, F.struct(collected, name)).alias("_name"))
    groups = numbered(
        latest, [], [F.desc("_latest"), values.locale(F.col("_name")).asc(), F.asc(vendor)], "group_place",
    ).select(F.col(vendor).alias("_v"), "group_place")
    placed = numbered(entries, [vendor], [F.coalesce(F.col(issued).cast("timestamp"), F.col(collected)).desc(), F.desc(collected)])
    return placed.join(groups, F.col(vendor).eqNullSafe(F.col("_v"))).drop("_v")


def month_state(day: Column, month: str) -> Column:
    """matched, before, after or undated, by a month `YYYY-MM`."""
    own = F.date_format(day, "yyyy-MM")
    return F.when(own.isNull(), "undated").when(own == month, "matched").when(own < month, "before").otherwise("after")


def month_counts(refs: DataFrame, keys: Sequence[str], day: Column, month: str) -> DataFrame:
    """Counts of the four states for each key; `filtered` is false where an undated ref makes the whole supplier fall back to all history."""
    state = month_state(day, month)
    counts = [F.count_if(state == s).alias(s) for s in ("matched", "before", "after", "undated")]
    return refs.groupBy(*keys).agg(*counts).withColumn("filtered", F.col("undated") == 0)


def month_filter(refs: DataFrame, keys: Sequence[str], day: Column, month: str) -> DataFrame:
    """The refs of the month, and all refs of keys with an undated one."""
    state = month_state(day, month)
    undated = refs.where(state == "undated").select(*keys).distinct()
    return refs.where(state == "matched").join(undated, list(keys), "left_anti").unionByName(refs.join(undated, list(keys), "left_semi"))
