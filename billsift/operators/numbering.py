"""Numbers over ordered rows that do not gather a key in one task."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

ROW_BITS = 33  # of monotonically_increasing_id: the lower ones number the rows of a partition


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table of the shared folder: what is read again is the same, whatever executors are lost."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """`df` with the number of each row among those of its key, from 1, in `order`; rows of equal order are numbered in any order.

    Rows are dealt by ranges of key and order, so a key with many rows lies in several tasks. Each counts its own
    rows, and the counts before a range (one row for each key and range) are added.
    """
    places = [F.asc_nulls_first(k) for k in keys] + list(order)
    dealt = df.repartitionByRange(*places).sortWithinPartitions(*places).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "numbered").withColumn("_range", F.shiftright("_at", ROW_BITS))
    counts = dealt.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), "_first", before.alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dealt.join(starts, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
