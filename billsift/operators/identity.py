"""Identities and deduplication: duplicate ids, aliases, seen keys, content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds

MAX_ALIASES = 4


def disambiguate(refs: DataFrame, keys: Sequence[str], id: str, discriminator: Column, pos: Column) -> DataFrame:
    """`refs` with `<id>_unique`: an id that stands for several things gets 24 hex digits of its discriminator's hash.

    A ref without a discriminator is told from others by its place: within its group for the test, and in the whole list
    (`pos`) for the suffix. That an id stands for several things shows in the least and greatest discriminator and in how
    many refs have none, so no set is gathered.
    """
    told = refs.withColumns({"_d": discriminator.cast("string"), "_at": F.concat(F.lit("position:"), pos.cast("string"))})
    none = F.count_if(F.col("_d").isNull())
    several = F.coalesce(F.min("_d") != F.max("_d"), F.lit(False)) | ((none > 0) & (F.count("*") > 1))
    many = told.groupBy(*keys, id).agg(several.alias("_many"))
    suffixed = F.concat(F.col(id).cast("string"), F.lit("-"), F.substring(F.sha2(F.coalesce("_d", "_at"), 256), 1, 24))
    joined = told.join(many, [*keys, id], "left")
    return joined.withColumn(f"{id}_unique", F.when(F.col("_many"), suffixed).otherwise(F.col(id).cast("string"))).drop("_d", "_at", "_many")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str], best: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """The first row of each key by `order`; each (column, score) of `best` is taken from the row of the highest score, the earlier one in a tie.

    Rows with a null or blank key are left out. Only the running first and best are held, never a group.
    """
    named = rows
    for k in keys:
        named = named.where(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    upgraded = [c for c, _ in best]
    rest = [c for c in rows.columns if c not in keys and c not in upgraded]
    place = F.struct(*order)
    scored = named.select("*", place.alias("_at"), *[s.alias(f"_s{i}") for i, (_, s) in enumerate(best)])
    aggs = [F.min_by(F.struct(*rest), "_at").alias("_first")]
    for i, c in enumerate(upgraded):
        # highest score first, then earliest: the least of (-score, place)
        aggs.append(F.min_by(F.col(c), F.struct((-F.col(f"_s{i}")).alias("s"), "_at")).alias(c))
    return scored.groupBy(*keys).agg(*aggs).select(*keys, "_first.*", *upgraded)


def unseen(refs: DataFrame, seen: DataFrame, key: str = "key", aliases: str | None = None, pos: str = "pos") -> DataFrame:
    """Refs of which neither the key nor any of the first MAX_ALIASES aliases is in `seen` (key): a left anti join on each."""
    known = seen.select(F.col(key).alias("_k")).distinct()
    if aliases is None:
        return refs.join(known, refs[key] == known["_k"], "left_anti")
    named = F.concat(F.array(F.col(key)), F.slice(F.coalesce(F.col(aliases), F.array().cast("array<string>")), 1, MAX_ALIASES))
    hit = refs.select(pos, F.explode(named).alias("_k")).join(known, "_k", "left_semi").select(pos).distinct()
    return refs.join(hit, pos, "left_anti")


def migrated(refs: DataFrame, seen: DataFrame, key: str = "key", aliases: str = "aliases", pos: str = "pos") -> DataFrame:
    """Primary keys to add to `seen`: those not in it of refs known by an alias."""
    known = seen.select(F.col(key).alias("_k")).distinct()
    by_alias = refs.select(pos, F.explode(F.slice(F.col(aliases), 1, MAX_ALIASES)).alias("_k")).join(known, "_k", "left_semi").select(pos).distinct()
    return refs.join(by_alias, pos, "left_semi").join(known, refs[key] == known["_k"], "left_anti").select(key).distinct()


def emitted_once(refs: DataFrame, scope: Sequence[str], key: str = "key", aliases: str = "aliases", pos: str = "pos") -> DataFrame:
    """Refs that a run emits: in order of `pos`, one is dropped if its key or an alias is already held.

    A kept ref holds its key and aliases, a dropped one its key alone, so the rule is no closure and needs the order. A fold
    over each scope's refs, sorted by Spark; its state is the names that are held. Scopes where no name comes twice can't drop
    anything and are not folded.
    """
    names = F.array_distinct(F.concat(F.array(F.col(key)), F.slice(F.coalesce(F.col(aliases), F.array().cast("array<string>")), 1, MAX_ALIASES)))
    each = refs.select(*scope, F.col(pos).alias("_p"), names.alias("_names"))
    repeated = each.select(*scope, F.explode("_names").alias("_k")).groupBy(*scope, "_k").count().where("count > 1").select(*scope).distinct()
    kind = dict(each.dtypes)["_p"]
    kept = folds.folded(each.join(repeated, list(scope), "left_semi"), scope, [F.col("_p")], [F.col("_p"), F.col("_names")], folds.Emitted, f"`{pos}` {kind}")
    return refs.join(repeated, list(scope), "left_anti").unionByName(refs.join(kept, [*scope, pos], "left_semi").select(*refs.columns))


def scoped_identity(scope: Sequence[tuple[str, Column]], id: Column) -> Column:
    """The scope as a JSON list of [option, value] pairs, NUL, and the id; without a scope the id alone."""
    if not scope:
        return id.cast("string")
    pairs = F.array(*[F.array(F.lit(o), v.cast("string")) for o, v in scope])
    return F.concat(F.to_json(pairs), F.lit("\0"), id.cast("string"))


def same_content(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """(content_sha256, first, n_copies): the least `order` of each content; null content counts as empty."""
    return rows.groupBy(
        F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256).alias("content_sha256")
    ).agg(F.min(order).alias("first"), F.count("*").alias("n_copies"))


def repaired(docs: DataFrame, accepted: DataFrame, key: str = "key", content: str = "content_key") -> DataFrame:
    """Primary keys to add to the accepted ones (`key`): those of documents whose content was accepted under another key, as when the last step of a delivery was lost."""
    known = accepted.select(F.col("key").alias("_k")).distinct()
    delivered = docs.join(known, F.col(content) == F.col("_k"), "left_semi")
    return delivered.join(known, F.col(key) == F.col("_k"), "left_anti").select(F.col(key).alias("key")).distinct()
