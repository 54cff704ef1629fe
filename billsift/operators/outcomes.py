"""Outcomes of runs: routes remembered, failures in a row, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds

from ..functions.values import CAUSES

MAX_MISSES = 3
PHASES = ("auth", "list", "document", "deliver", "unknown")


def classified(df: DataFrame, cause: str) -> DataFrame:
    """`df` with `stage` and `code` of its cause, by the fixed table of causes; an unknown cause is `unknown`."""
    known = df.sparkSession.createDataFrame([(k, s, c) for k, (s, c) in CAUSES.items()], f"`{cause}` string, stage string, code string")
    joined = df.join(F.broadcast(known), cause, "left")
    return joined.withColumns({"stage": F.coalesce("stage", F.lit("unknown")), "code": F.coalesce("code", F.lit("unknown"))})


def failures_in_row(runs: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """For each key, the number of failed runs after its last good one, and when that was.

    Two aggregates by key, so a key with very many runs is combined in the map tasks.
    """
    at = F.struct(*order)
    good = runs.groupBy(*keys).agg(F.max(F.when(~failed, at)).alias("_good"))
    after = runs.join(good, list(keys)).where(F.col("_good").isNull() | (at > F.col("_good")))
    counted = after.groupBy(*keys).agg(F.count("*").alias("failures"))
    return good.join(counted, list(keys), "left").select(
        *keys, F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), F.col(f"_good.{order[0]}").alias("last_good"),
    )


def route_memory(events: DataFrame, keys: Sequence[str], order: Sequence[str], route: str, confirmed: Column) -> DataFrame:
    """(keys, route, previous, misses): what is remembered of each key's route after its confirmations and misses.

    A confirmation sets the route and no misses, and keeps the route before it; the third miss in a row
    falls back to the route before, or forgets the key. A fold in order of time over each key's events; a confirmation
    without a route says nothing.
    """
    told = events.where(~confirmed | F.col(route).isNotNull())
    hit = F.when(confirmed, F.col(route).cast("string"))
    found = folds.folded(told, keys, [*map(F.col, order), hit], [hit], lambda: folds.Remembered(MAX_MISSES), "route string, previous string, misses long")
    return found.select(*keys, "route", "previous", "misses")


def watermark(suppliers: DataFrame, complete: str, last_run: str, ok: Column) -> DataFrame:
    """(covered_until, pending): the least complete time (or last good run's) of all suppliers; null while some have none."""
    own = F.coalesce(F.col(complete), F.when(ok, F.col(last_run)))
    return suppliers.agg(F.min(own).alias("_least"), F.count_if(own.isNull()).alias("pending")).select(
        F.when(F.col("pending") == 0, F.col("_least")).alias("covered_until"), "pending",
    )


def first_failure(phases: Column) -> Column:
    """Of an array of (phase, status) the first that failed, in the fixed order of phases."""
    order = F.array(*map(F.lit, PHASES))
    failed = F.filter(phases, lambda p: p["status"] == "failed")
    return F.array_min(F.transform(failed, lambda p: F.struct(F.array_position(order, p["phase"]).alias("at"), p["phase"].alias("phase"))))["phase"]
