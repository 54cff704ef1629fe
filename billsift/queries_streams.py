"""Registered queries that run a stream to its end into a Parquet table of the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query, table
from .session import shared_dir
from .streaming import commit

HOUR = 3600


def _run(spark: SparkSession, found: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run = found.writeStream.format("parquet").option(
        "checkpointLocation", f"{path}/checkpoint",
    ).trigger(availableNow=True).outputMode("append").start(f"{path}/rows")
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/rows")


@query("""
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS scope, event_id AS r, epoch_us(ts) AS t,
    event_type, 'k' || (event_id % 11) AS key, 'k' || (event_id * 7 % 11) AS alias, 'content:c' || (event_id % 5) AS content FROM events),
a AS (SELECT scope, r, t, 2 * r AS pos, 'claim' AS action, key, alias, content FROM e
  UNION ALL SELECT scope, r, t + (r * 37 % 20) * 3600000000, 2 * r + 1, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'accept' END, key, alias,
      content FROM e),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY t, pos) AS i FROM a),
s(scope, i, pos, action, result, acc, held) AS (
  SELECT DISTINCT scope, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::STRUCT(name VARCHAR, until BIGINT)[], []::STRUCT(name VARCHAR,
      r BIGINT, until BIGINT)[] FROM n
  UNION ALL
  SELECT scope, i, pos, action, result,
    CASE WHEN result = 'seen' AND seen <> key THEN list_append(acc, own) WHEN result = 'repeated' THEN list_append(acc, own)
        WHEN result = 'emitted' THEN list_concat(acc, [own, {'name': content, 'until': own.until}]) ELSE acc END,
    CASE WHEN result = 'granted' THEN list_concat(held,
        [{'name': key, 'r': r, 'until': t + 21600000000}, {'name': alias, 'r': r, 'until': t + 21600000000}])
        WHEN action <> 'claim' THEN list_filter(held, lambda h: h.r <> r) ELSE held END
  FROM (SELECT *, {'name': key, 'until': t + 432000000000} AS own,
      CASE WHEN action = 'claim' THEN CASE WHEN seen IS NOT NULL THEN 'seen' WHEN len(list_filter(held, lambda h: h.name = key
          OR h.name = alias)) > 0 THEN 'busy' ELSE 'granted' END
        WHEN len(list_filter(held, lambda h: h.r = r)) = 0 THEN 'expired' WHEN action = 'fail' THEN 'released' WHEN list_contains(names,
            content) THEN 'repeated' ELSE 'emitted' END AS result
    FROM (SELECT *, CASE WHEN list_contains(names, key) THEN key WHEN list_contains(names, alias) THEN alias END AS seen
      FROM (SELECT *, list_transform(acc, lambda x: x.name) AS names
        FROM (SELECT n.*, list_filter(s.acc, lambda x: x.until > n.t) AS acc, list_filter(s.held, lambda h: h.until > n.t) AS held FROM s
            JOIN n ON n.scope = s.scope AND n.i = s.i + 1)))))
SELECT scope, pos, action, result FROM s WHERE i > 0""")
def stream_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event claims a document for its user; an outcome comes hours later, some after the claim's lease."""
    id, name = F.col("event_id"), lambda c: F.concat(F.lit("k"), c.cast("string"))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("scope"), F.col("ts").cast("timestamp").alias("ts"), id.alias("claim"), "event_type", name(id % 11).alias("key"), F.array(name(id * 7 % 11)).alias("aliases"),
        F.concat(F.lit("c"), (id % 5).cast("string")).alias("content"),
    )
    names = ["scope", "ts", "pos", "action", "claim", "key", "aliases", "content"]
    claims = events.withColumns({"pos": F.col("claim") * 2, "action": F.lit("claim")}).select(*names)
    later = F.timestamp_micros(F.unix_micros("ts") + F.col("claim") * 37 % 20 * HOUR * 1_000_000)
    ends = events.withColumns(
        {"ts": later, "pos": F.col("claim") * 2 + 1, "action": F.when(F.col("event_type") == "error", "fail").otherwise("accept")}
    ).select(*names)
    path = f"{shared_dir(spark)}/actions-{uuid.uuid4().hex}"
    actions = claims.unionByName(ends)
    actions.write.parquet(path)
    stream = spark.readStream.schema(actions.schema).parquet(path)
    return _run(spark, commit.commits(stream, lease_s=6 * HOUR, retention_s=5 * 24 * HOUR), "commits").select("scope", "pos", "action", "result")
