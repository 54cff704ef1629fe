"""Leases: many keys share the state of their bucket; the events table may be a folder."""

import datetime as dt

from pyspark.sql import functions as F

from billsift import queries
from billsift.streaming import state

BASE = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def run(stream, out, keys):
    query = state.leased(stream, keys, ties=["id"]).writeStream.format("parquet").option(
        "checkpointLocation", f"{out}/checkpoint",
    ).outputMode("append").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return query


def test_many_keys_take_no_more_state_rows_than_buckets(spark, tmp_path):
    schema = "a string, b int, ts timestamp, id long"
    rows = [(f"k{i % 1500}", i % 2, BASE + dt.timedelta(seconds=i // 1500 * 200), i) for i in range(6000)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["a", "b"])
    updated = [s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(updated) <= state.BUCKETS < 1500
    got = sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    assert got == [i for i in range(6000) if i // 1500 % 2 == 0]  # every 200 s an event, so each second one is held


def test_keys_with_nulls_and_like_texts_are_apart(spark, tmp_path):
    schema = "a string, b string, ts timestamp, id long"
    pairs = [("x", None), (None, "x"), ("x1:", "y"), ("x", "1:y"), (None, None), ("", None), ("-", None), (None, "-")]
    rows = [(a, b, BASE, i) for i, (a, b) in enumerate(pairs)] + [("x", None, None, 90), ("z", None, None, 91)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["a", "b"])
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == list(range(len(pairs)))


def test_lease_query_reads_a_folder(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    digest = lambda d: queries.stream_dedup_lease(spark, d).agg(F.count("*"), F.sum(F.hash("event_id", "user_id", "event_type"))).first()
    assert digest(str(tmp_path)) == digest(sf_dir) and digest(sf_dir)[0] > 0
