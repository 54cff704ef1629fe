"""Documents that a page offers: links, controls, the evidence about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy, urls, values

MAX_ACTIONS, MAX_EVIDENCE, MAX_RESOURCES = 12, 32, 12
# What words in a captured resource say of it.
RESOURCE_POINTS = (("invoice|receipt|statement", 100), ("billing|transaction|charge", 50), ("payment|subscription|plan", 25))


def enumeration(candidates: DataFrame, keys: Sequence[str], url: str = "url", action: str = "action", most: int = MAX_ACTIONS) -> DataFrame:
    """(keys, observed, direct, actions, resolved, unresolved, unstable, ambiguous, truncated) of a page's candidates.

    A candidate has a `url`, or else an `action` identity, or neither (unstable). Two of one identity are ambiguous and not
    merged; of the others `most` are taken, 12 at most. Counted in two steps, so one page's candidates are never gathered.
    """
    free = F.col(url).isNull()
    identity = F.when(free, F.col(action))
    each = candidates.groupBy(*keys, identity.alias("_action")).agg(F.count("*").alias("_n"), F.count_if(~free).alias("_direct"))
    named = F.col("_action").isNotNull()
    stable = F.count_if(named & (F.col("_n") == 1))
    taken = F.least(stable, F.lit(max(1, min(MAX_ACTIONS, most))))
    direct = F.sum("_direct")
    counted = each.groupBy(*keys).agg(
        F.sum("_n").alias("observed"), direct.alias("direct"), taken.alias("actions"), (direct + taken).alias("resolved"),
        F.greatest(F.sum("_n") - direct - taken, F.lit(0)).alias("unresolved"), F.coalesce(
            F.sum(F.when(~named, F.col("_n") - F.col("_direct"))), F.lit(0),
        ).alias("unstable"),
        F.coalesce(F.sum(F.when(named & (F.col("_n") > 1), F.col("_n"))), F.lit(0)).alias("ambiguous"), (stable > taken).alias("truncated"),
    )
    return counted


def merged_evidence(rows: DataFrame, keys: Sequence[str], evidence: Column, order: str, most: int = MAX_EVIDENCE) -> DataFrame:
    """(keys, evidence): the distinct pieces of evidence of each key as JSON, in the order in which they first came, the first `most`.

    Pieces are made distinct and ranked before anything is gathered, so an array has at most `most` entries.
    """
    first = rows.select(*keys, F.to_json(evidence).alias("_e"), order).where(F.col("_e").isNotNull()).groupBy(*keys, "_e").agg(F.min(order).alias("_at"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "_e"))
    kept = first.withColumn("_turn", turn).where(F.col("_turn") <= most)
    return kept.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_turn", "_e"))), lambda x: x["_e"]).alias("evidence"))


def link_refs(links: DataFrame, keys: Sequence[str], href: str, order: str) -> DataFrame:
    """(keys, document, url, id, alias, pos): one row for each document that the links of a page lead to.

    Links are one document if their canonical addresses are equal; the most stable address stays, the first of several.
    `alias` is the id of older runs (the last path segment), where it differs and is no other document's as well.
    """
    canonical = urls.canonical_document_url(F.col(href))
    best = F.min_by(F.col(href), F.struct((-urls.stability_score(F.col(href))).alias("s"), F.col(order).alias("o")))
    each = links.select(*keys, canonical.alias("document"), href, order).groupBy(*keys, "document").agg(best.alias("url"), F.min(order).alias("pos"))
    id = policy.id_from_href(F.col("document"))
    each = each.withColumns({"id": id, "_old": F.when(id.startswith("document-"), id).otherwise(F.regexp_replace(id, r"-[0-9a-f]{24}\z", ""))})
    shared = each.groupBy(*keys, "_old").agg(F.count("*").alias("_n"))
    alias = F.when((F.col("_old") != F.col("id")) & (F.col("_n") == 1), F.col("_old"))
    return each.join(shared, [*keys, "_old"]).select(*keys, "document", "url", "id", alias.alias("alias"), "pos")


def with_evidence(refs: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`refs` with the `evidence` (keys, evidence) of the same keys, an empty list where there is none."""
    return refs.join(evidence, list(keys), "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def ranked_resources(
    resources: DataFrame, keys: Sequence[str], method: str, url: str, body: str, request: str, order: str, most: int = MAX_RESOURCES,
) -> DataFrame:
    """The first response of each request (method, address, body sent), the `most` that speak most of billing, then by address, with `score` and `rank`.

    The first 4,000 characters of a body are looked at; this is the rule for ranking, bodies stay whole.
    """
    rest = [c for c in resources.columns if c not in keys]
    request_key = [F.coalesce(F.col(method), F.lit("GET")).alias("_m"), F.col(url).alias("_u"), F.coalesce(F.col(request), F.lit("")).alias("_b")]
    first = resources.groupBy(*keys, *request_key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")
    said = F.lower(F.concat_ws(" ", F.col(url), F.substring(body, 1, 4000)))
    score = sum((F.when(said.rlike(words), F.lit(points)).otherwise(F.lit(0)) for words, points in RESOURCE_POINTS), F.lit(0))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), values.locale(F.col(url)), url))
    return first.withColumn("score", score).withColumn("rank", turn).where(F.col("rank") <= max(1, min(MAX_RESOURCES, most)))


def auth_probe(requests: DataFrame, keys: Sequence[str], origin: str, method: str, status: str, url: str, order: str) -> DataFrame:
    """(keys, probe): the first GET of a key that was answered with 200, by its own `origin`, at an address that tells who is signed in."""
    # Fixed value: addresses of sessions and accounts.
    whoami = r"(?i)/(me|users?/me|account|session|profile|organizations?|whoami)(/|\?|$)"
    good = (F.col(method) == "GET") & (F.col(status) == 200) & (urls.origin_of(F.col(url)) == F.col(origin)) & F.col(url).rlike(whoami)
    return requests.where(good).groupBy(*keys).agg(F.min_by(url, order).alias("probe"))


def source_catalog(recipes: DataFrame, profiles: DataFrame, connections: DataFrame, id: str, name: str) -> DataFrame:
    """(id, name, kind, place): the packaged recipes that are connected, in their own order, then the discovered profiles by name.

    `recipes` has a column `place`; one row for each source.
    """
    own = recipes.join(connections.select(id).distinct(), id, "left_semi").select(id, name, F.lit("official").alias("kind"), "place")
    found = profiles.select(id, name, F.lit("discovered").alias("kind"), F.lit(None).cast("long").alias("place"))
    return own.unionByName(found)


def extended_origins(profiles: DataFrame, needed: DataFrame, id: str, origins: str, provider: str, semantic: str) -> DataFrame:
    """(`id`, origins, unmatched): a profile's document origins with those of `needed` (`id`, origin, provider) that its provider or a semantic action admits.

    `unmatched` lists the others; a caller refuses a profile that has any. Origins are sorted.
    """
    asked = needed.select(id, F.col("origin").alias("_origin"), F.col(provider).alias("_provider")).distinct()
    both = profiles.join(asked, id, "left")
    fits = F.coalesce(F.col("_provider") == F.col(provider), F.lit(False)) | F.coalesce(F.col(semantic), F.lit(False))
    return both.groupBy(id).agg(
        F.array_sort(F.array_union(F.first(origins), F.array_compact(F.collect_set(F.when(fits, F.col("_origin")))))).alias("origins"),
        F.array_sort(F.collect_set(F.when(~fits, F.col("_origin")))).alias("unmatched"),
    )
