"""Ranking of routes, candidates and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from . import numbering

# What each adapter is worth.
ADAPTERS = {"network-json": 300, "embedded-json": 200, "dom-links": 100, "dom-actions": 80}
ROUTE_POINTS, COUNT_POINTS = 40, 25
NAME_CUT = r"\s*[|·•–—:]\s*|\s+-\s+"


def frontier(targets: DataFrame, keys: Sequence[str], url: str = "url", source: str = "source", family: str = "family", score: str = "score") -> DataFrame:
    """`targets` with `rank` in each key: remembered routes, then common ones, then one target of each family in turn.

    Within each of these by score, then URL in locale order; families take turns in order of name.
    """
    kind = F.when(F.col(source) == "remembered", 0).when(F.col(source) == "common_route", 1).otherwise(2)
    group = F.when(kind == 2, F.col(family)).otherwise(F.lit(""))
    turn = Window.partitionBy(*keys, "_kind", "_family").orderBy(F.col(score).desc(), values.locale(F.col(url)), url)
    placed = targets.withColumns({"_kind": kind, "_family": group}).withColumn("_turn", F.row_number().over(turn))
    # The first two kinds have one queue each; only in the third do queues take turns.
    rank = Window.partitionBy(*keys).orderBy("_kind", "_turn", "_family")
    return placed.withColumn("rank", F.row_number().over(rank)).drop("_kind", "_family", "_turn")


def best_by_key(rows: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The row of the highest score of each key; the least `tie` of those at a par."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), *tie)).alias("_best")).select(*keys, "_best.*")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    turn = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def candidate_score(adapter: Column, route: Column, count: Column) -> Column:
    base = F.coalesce(*[F.when(adapter == a, F.lit(n)) for a, n in ADAPTERS.items()], F.lit(0))
    return base + F.least(F.greatest(route, F.lit(0)), F.lit(ROUTE_POINTS)) + F.least(count, F.lit(COUNT_POINTS))


def within_budget(sizes: Column, budget: int) -> Column:
    """Flags for an array of sizes in order: an item that would exceed the budget is skipped, and later ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("fits"))
    def step(s: Column, n: Column) -> Column:
        ok = s["used"] + n <= budget
        return F.struct((s["used"] + F.when(ok, n).otherwise(0)).cast("long").alias("used"), F.concat(s["fits"], F.array(ok)).alias("fits"))
    return F.aggregate(sizes, start, step)["fits"]


def title_fragments(title: Column) -> Column:
    """The parts of a page title between its separators, white space made plain."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.trim(title), r"\s+", " "), NAME_CUT), lambda x: F.trim(x)), lambda x: x != "")


def stable_names(observations: DataFrame, keys: Sequence[str], title: str = "title", least: int = 2) -> DataFrame:
    """(keys, name, n_titles): the title fragment on the most distinct titles, at least `least`; the shorter, then lesser one in a tie."""
    titles = observations.where(F.trim(title) != "").select(*keys, F.regexp_replace(F.trim(title), r"\s+", " ").alias("_t")).distinct()
    parts = titles.select(*keys, F.explode(F.array_distinct(title_fragments(F.col("_t")))).alias("name"))
    counted = parts.groupBy(*keys, "name").agg(F.count("*").alias("n_titles")).where(F.col("n_titles") >= least)
    return best_by_key(counted.withColumn("_len", F.length("name")), keys, "n_titles", ["_len", "name"]).drop("_len")


def display_name(stable: Column, declared: Column, domain: Column) -> Column:
    """The name that most independent sources agree on: stable over titles, then declared by the site, then the domain's."""
    return F.coalesce(stable, declared, F.nullif(domain, F.lit("")), F.lit("Discovered Supplier"))


# What a target is worth by how it was found.
BASES = {"remembered": 160, "common_route": 100, "link": 85}
PLANNED = 79


def planned_targets(
    links: DataFrame, keys: Sequence[str], url: str, source: str, family: str, path: Column, semantic: Column, depth: Column, most: int = PLANNED,
) -> DataFrame:
    """The targets that a search goes to next, with `score` and `rank`: the best of each URL by base, path and label less depth, in the frontier's order, `most` of each key."""
    base = F.coalesce(*[F.when(F.col(source) == k, F.lit(n)) for k, n in BASES.items()], F.lit(0))
    scored = links.select(*keys, url, source, family, (base + path + semantic - depth).alias("score"))
    best = best_by_key(scored, [*keys, url], "score", [source, family])
    return frontier(best, keys, url, source, family).where(F.col("rank") <= most)


def in_locale_order(names: DataFrame, name: str, place: str = "place") -> DataFrame:
    """`names` with their places, from 1, in locale order, then by letters' codes; sorted by ranges, in as many tasks as there are."""
    return numbering.numbered(names, [], [values.locale(F.col(name)).asc(), F.asc(name)], place)


def confidence(items: Column, has_document: Column, real_probe: Column) -> Column:
    """How sure an inferred recipe is: high, medium or low."""
    return F.when((items >= 2) & has_document & real_probe, "high").when((items >= 1) & (has_document | real_probe), "medium").otherwise("low")
