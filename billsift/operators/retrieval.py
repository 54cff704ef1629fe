"""Proofs that a listing was complete, scopes, run roll-ups, catalogues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terminations that prove an end, and the bounds of a proof's numbers.
COMPLETE = ("explicit_end", "stable_end")
MAX_ITEMS, MAX_PAGES = 10_000, 100
PAGE_CAP = 20
SCOPE_VALUES, SCOPES = 50, 100


def proof(df: DataFrame, termination: Column, pages: Column, observed: Column, resolved: Column, unresolved: Column) -> DataFrame:
    """`df` with completeness, pages_visited and the three item counts.

    Counts that are null, negative, over MAX_ITEMS or do not add up support no claim: all that was
    observed then counts as unresolved. Complete is only an explicit or stable end with nothing unresolved.
    """
    held = lambda c, low, high: F.coalesce(F.least(F.greatest(c, F.lit(low)), F.lit(high)), F.lit(low)).cast("long")
    valid = reduce(Column.__and__, [F.coalesce(c.between(0, MAX_ITEMS), F.lit(False)) for c in (observed, resolved, unresolved)])
    sound = valid & F.coalesce(resolved + unresolved == observed, F.lit(False))
    seen = held(observed, 0, MAX_ITEMS)
    left = F.when(sound, held(unresolved, 0, MAX_ITEMS)).otherwise(seen)
    complete = F.coalesce(termination.isin(*COMPLETE), F.lit(False)) & sound & (left == 0)
    return df.withColumns({
        "completeness": F.when(complete, "complete").otherwise("partial"), "pages_visited": held(pages, 1, MAX_PAGES), "observed_items": seen,
        "resolved_items": F.when(sound, held(resolved, 0, MAX_ITEMS)).otherwise(F.lit(0).cast("long")), "unresolved_items": left,
    })


def walked(pages: DataFrame, source: str, seq: str, more: Column, state: Column, items: Column, cap: int = PAGE_CAP) -> DataFrame:
    """(source, termination, n_pages, observed): how a walk over the pages of each source ends.

    A page that says there is no more ends it (explicit_end); one that says there is but gives no
    usable state (null or blank) fails it (continuation_failed); a state met before stops it
    (repeated_state), the cap too (page_cap). The earliest of these holds. The last stored page
    of a source that says there is more without a reason to stop is a failed continuation as well.
    Only the first `cap` pages are ever walked; repeats are found by (source, state), not by gathering pages.
    """
    p = pages.select(
        F.col(source), F.col(seq).alias("_seq"), F.coalesce(more, F.lit(False)).alias("_more"), state.cast("string").alias("_state"),
        items.alias("_items"),
    )
    p = p.where(F.col("_seq") < cap)
    first = p.where("_more").groupBy(source, "_state").agg(F.min("_seq").alias("_first"))
    told = p.join(first, [source, "_state"], "left")
    blank = F.coalesce(F.trim("_state") == "", F.lit(True))
    cause = (
        F.when(~F.col("_more"), "explicit_end").when(blank, "continuation_failed").when(
            F.col("_first") < F.col("_seq"), "repeated_state",
        ).when(F.col("_seq") == cap - 1, "page_cap")
    )
    causes = told.withColumn("_cause", cause)
    ends = causes.where("_cause IS NOT NULL").groupBy(source).agg(F.min(F.struct("_seq", "_cause")).alias("_end"))
    joined = causes.join(ends, source, "left").where(F.col("_end").isNull() | (F.col("_seq") <= F.col("_end._seq")))
    return joined.groupBy(source).agg(
        F.coalesce(F.first("_end._cause"), F.lit("continuation_failed")).alias("termination"), F.count("*").alias("n_pages"), F.sum("_items").alias("observed")
    )


def summary(proofs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of complete and partial proofs, sums of their items, and the distinct terminations, sorted."""
    return proofs.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("completeness") == "complete").alias("complete"), F.count_if(F.col("completeness") == "partial").alias("partial"),
        F.sum("observed_items").alias("observed"), F.sum("resolved_items").alias("resolved"), F.sum("unresolved_items").alias("unresolved"),
        F.array_join(F.array_sort(F.collect_set("termination")), ",").alias("terminations"),
    )


def scopes(options: DataFrame, keys: Sequence[str], option: str, value: str, order: Sequence[str]) -> DataFrame:
    """(keys, scope): every combination of one value for each of a key's options, as a map; options in order of name.

    An option of more than SCOPE_VALUES values or more than SCOPES combinations is an error, as the caller's
    run would be too; blank values are no values. The bounds keep each key's product small, so it is a fold over arrays.
    """
    given = options.where(F.trim(F.col(value).cast("string")) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_v")))), lambda x: x["_v"])
    each = given.groupBy(*keys, option).agg(F.array_distinct(ordered).alias("_values"))
    fits = F.when(F.size("_values") > SCOPE_VALUES, F.raise_error(F.lit(f"an option has over {SCOPE_VALUES} values"))).otherwise(F.col("_values"))
    per = each.withColumn("_values", fits).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(option).alias("o"), F.col("_values").alias("v")))).alias("_o")
    )
    count = F.aggregate("_o", F.lit(1).cast("long"), lambda n, x: n * F.size(x["v"]))
    none = F.array(F.create_map().cast("map<string,string>"))
    grown = F.aggregate(
        "_o", none, lambda done, x: F.flatten(F.transform(done, lambda d: F.transform(x["v"], lambda v: F.map_concat(d, F.create_map(x["o"], v))))),
    )
    bounded = F.when(count > SCOPES, F.raise_error(F.lit(f"over {SCOPES} scopes")).cast("array<map<string,string>>")).otherwise(grown)
    return per.select(*keys, F.explode(bounded).alias("scope"))


def preview_scopes(options: DataFrame, keys: Sequence[str], option: str, value: str, order: Sequence[str], most: int = 20) -> DataFrame:
    """(keys, place, scope): the first `most` combinations of `scopes`, options by name, the last one changing fastest.

    Built option after option and cut to `most` each time, so no more than `most` times an option's values are ever held.
    """
    given = options.where(F.trim(F.col(value).cast("string")) != "")
    ordered = F.slice(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_v")))), lambda x: x["_v"])), 1,
        most,
    )
    per = given.groupBy(*keys, option).agg(ordered.alias("_values")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(option).alias("o"), F.col("_values").alias("v")))).alias("_o")
    )
    none = F.array(F.create_map().cast("map<string,string>"))
    grown = F.aggregate(
        "_o", none,
        lambda done, x: F.slice(F.flatten(F.transform(done, lambda d: F.transform(x["v"], lambda v: F.map_concat(d, F.create_map(x["o"], v))))), 1, most),
    )
    return per.select(*keys, F.posexplode(grown).alias("place", "scope"))


def coverage(recipes: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, problem): recipes without an entry (missing), entries without a recipe (orphan), and keys entered twice (duplicate)."""
    a, b = recipes.select(key).distinct(), entries.groupBy(key).agg(F.count("*").alias("_n"))
    missing = a.join(b, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    orphan = b.join(a, key, "left_anti").select(key, F.lit("orphan").alias("problem"))
    return missing.unionByName(orphan).unionByName(b.where("_n > 1").select(key, F.lit("duplicate").alias("problem")))
