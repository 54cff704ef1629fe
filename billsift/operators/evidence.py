"""Weighted evidence: one value for each field of a record, or none where the evidence is at odds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the confidence labels.
MOST = 32
WEIGHTS = {"low": 1, "medium": 2, "high": 3}


def weight_of(confidence: Column) -> Column:
    return F.coalesce(*[F.when(confidence == k, F.lit(w)) for k, w in WEIGHTS.items()])


def resolve(claims: DataFrame, keys: Sequence[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """(keys, value, n_claims, conflict): the value of the greatest weight, then of the most claims.

    Values that tie on both are a conflict, and the field is withheld (null). Null values are no
    claims; a record with nothing but those has no row. Claims are summed by value in the map tasks
    first, so a record with very many claims shuffles one row for each value and task.
    """
    counted = claims.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.max(weight).alias("_w"), F.count("*").alias("_n"))
    best = Window.partitionBy(*keys).orderBy(F.col("_w").desc(), F.col("_n").desc())
    tied = counted.withColumn("_r", F.rank().over(best)).where("_r = 1")
    alone = F.count("*") == 1
    return tied.groupBy(*keys).agg(F.when(alone, F.min(value)).alias("value"), F.when(alone, F.min("_n")).alias("n_claims"), (~alone).alias("conflict"))


def bounded_claims(claims: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = MOST) -> DataFrame:
    """The first `most` pieces of evidence of each record, in order: direct fields should come first. What is beyond does not count."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return claims.withColumn("_turn", turn).where(F.col("_turn") <= most).drop("_turn")


def fields_as_claims(df: DataFrame, keys: Sequence[str], fields: Sequence[str], weight: Column) -> DataFrame:
    """(keys, field, value, weight): one row for each field that is not null."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(*keys, weight.alias("weight"), F.explode(pairs).alias("p")).select(*keys, "p.field", "p.value", "weight").where("value IS NOT NULL")


def conflicts(resolved: DataFrame, keys: Sequence[str], field: str = "field") -> DataFrame:
    """One row for each record: its resolved fields as `field=value`, and the fields in conflict, both sorted and comma-joined."""
    joined = lambda x: F.array_join(F.array_sort(F.collect_list(x)), ",")
    kept = F.when(~F.col("conflict"), F.concat_ws("=", field, "value"))
    return resolved.groupBy(*keys).agg(joined(kept).alias("fields"), joined(F.when(F.col("conflict"), F.col(field))).alias("conflicts"))


def issue_month(claims: DataFrame, keys: Sequence[str], date: str, weight: str = "weight") -> DataFrame:
    """(keys, month, conflict): `resolve` over the months of dates."""
    months = claims.withColumn("_month", F.date_format(date, "yyyy-MM"))
    return resolve(months, keys, "_month", weight).select(*keys, F.col("value").alias("month"), "conflict")
