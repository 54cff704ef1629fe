"""State over streams: leases on keys."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

LEASE_S, BUCKETS = 300, 1024


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a file or a folder of files, as a stream with an event-time column."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's path can't be one file
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _name(keys: list[str]) -> Column:
    """Key columns as one text: each with its length, or a sign for null, so different keys have different names."""
    texts = [F.col(k).cast("string") for k in keys]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leased(stream: DataFrame, keys: list[str], ts: str = "ts", lease_s: int = LEASE_S, ties: list[str] | None = None) -> DataFrame:
    """The events of each key that no lease holds: a kept event holds its key from its time until `lease_s` seconds later.

    A key's events of one batch are taken in order of time, then of `ties`; the order of keeping does not
    depend on how the stream is cut into batches, as long as events come in order. An event that comes after
    later ones is kept only if it also is no less than a lease before each kept one, so two kept events are
    never closer than a lease. Events without a time are dropped. The state holds the kept times that events within
    the watermark, a lease long, can still meet; then it goes. Keys share the state and the Python calls of their
    bucket by hash, of 1,024; a bucket's events of one batch are gathered in one task.
    """
    ship(stream.sparkSession)
    lease = lease_s * 1_000_000
    ordered = ["_at", *(ties or [])]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[str, list[int]] = {}  # kept times of each key, in order
        for name, at in zip(*state.get) if state.exists else ():
            held.setdefault(name, []).append(at)
        rows = pd.concat(list(frames)).sort_values(ordered, kind="stable")
        keep = []
        for name, at in zip(rows["_name"].tolist(), rows["_at"].tolist()):
            kept = held.setdefault(name, [])
            k = bisect_right(kept, at)
            free = (k == 0 or at - kept[k - 1] >= lease) and (k == len(kept) or kept[k] - at >= lease)
            keep.append(free)
            if free:
                kept.insert(k, at)
        watermark = state.getCurrentWatermarkMs()
        left = [(name, at) for name, kept in held.items() for at in kept if at + lease > watermark * 1000]
        state.update(([name for name, _ in left], [at for _, at in left]))
        state.setTimeoutTimestamp(max(max(kept[-1] for kept in held.values()) // 1000 + lease_s * 1000, watermark) + 1)
        yield rows.loc[keep, columns]

    columns = stream.columns
    named = stream.where(F.col(ts).isNotNull()).withWatermark(ts, f"{lease_s} seconds").withColumns({"_at": F.unix_micros(ts), "_name": _name(keys)})
    bucketed = named.withColumn("_bucket", F.pmod(F.xxhash64("_name"), F.lit(BUCKETS)))
    return bucketed.groupBy("_bucket").applyInPandasWithState(run, stream.schema, "names array<string>, starts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
