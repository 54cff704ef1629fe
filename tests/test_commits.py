"""Exactly-once commits against a plain fold, however the stream is cut, and over a restart."""

import datetime as dt
import os
import random
import re

import pytest

from billsift.sources import sinks
from billsift.streaming import commit

BASE = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "scope string, ts timestamp, pos long, action string, claim long, key string, aliases array<string>, content string"


def actions(seed, n=220):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at, scope = rng.randrange(20_000), rng.choice("ab")
        key, aliases, content = f"k{rng.randrange(9)}", [f"k{rng.randrange(9)}" for _ in range(rng.randrange(3))] or None, f"c{rng.randrange(12)}"
        rows.append((scope, at, 2 * i, "claim", i, key, aliases, content))
        if rng.random() < 0.9:
            rows.append((scope, at + rng.randrange(500), 2 * i + 1, rng.choice(["accept", "accept", "fail"]), i, key, aliases, content))
    return sorted(rows, key=lambda r: (r[1], r[2]))


def folded(rows, lease=300, retention=4000):
    out, accepted, held = [], {}, {}
    for scope, at, pos, action, claim, key, aliases, content in rows:
        ok = lambda n: accepted.get((scope, n), -1) > at
        if action == "claim":
            names = [key, *(aliases or [])]
            seen = [n for n in names if ok(n)]
            if seen:
                result = "seen"
                if seen[0] != key:
                    accepted[scope, key] = at + retention
            elif any(held.get((scope, n), (0, 0))[1] > at for n in names):
                result = "busy"
            else:
                result = "granted"
                held.update({(scope, n): (claim, at + lease) for n in names})
        else:
            mine = [k for k, (c, until) in held.items() if k[0] == scope and c == claim and until > at]
            for k in mine:
                del held[k]
            result = "expired" if not mine else "released" if action == "fail" else "repeated" if ok("c/" + content) else "emitted"
            if result in ("repeated", "emitted"):
                accepted[scope, key] = at + retention
            if result == "emitted":
                accepted[scope, "c/" + content] = at + retention
        out.append((scope, pos, result))
    return sorted(out)


def write(spark, rows, path, number):
    spark.createDataFrame([(s, BASE + dt.timedelta(seconds=at), *rest) for s, at, *rest in rows], SCHEMA).coalesce(1).write.parquet(f"{path}/part={number:03d}")
    for folder, _, names in os.walk(f"{path}/part={number:03d}"):
        for n in names:
            os.utime(os.path.join(folder, n), (number + 1_000_000, number + 1_000_000))  # files are taken in this order


def run(spark, path, out, one_by_one=True):
    reader = spark.readStream.schema(SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(path)
    found = commit.commits(stream, retention_s=4000)
    query = found.writeStream.format("parquet").option(
        "checkpointLocation", f"{out}/checkpoint",
    ).outputMode("append").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return sorted((r["scope"], r["pos"], r["result"]) for r in spark.read.parquet(f"{out}/rows").collect())


@pytest.mark.parametrize("files", [1, 3, 10])
def test_commits_are_a_fold(spark, tmp_path, files):
    rows = actions(files)
    step = -(-len(rows) // files)
    for i in range(files):
        write(spark, rows[i * step : (i + 1) * step], f"{tmp_path}/in", i)
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert got == folded(rows) and {r[2] for r in got} == {"granted", "seen", "busy", "emitted", "repeated", "released", "expired"}


def test_a_restart_repeats_nothing(spark, tmp_path):
    rows = actions(5)
    write(spark, rows[:150], f"{tmp_path}/in", 0)
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out") == folded(rows[:150])
    write(spark, rows[150:], f"{tmp_path}/in", 1)
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out") == folded(rows)
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out") == folded(rows)


def test_state_expires(spark, tmp_path):
    """Once the watermark has passed the retention, nothing of a scope is left but what came later."""
    rows = [
        ("a", 0, 0, "claim", 0, "k", None, "c"), ("a", 10, 1, "accept", 0, "k", None, "c"), ("b", 5000, 2, "claim", 1, "x", None, "y"),
        ("b", 9000, 4, "claim", 2, "z", None, "y"), ("b", 9001, 6, "claim", 3, "w", None, "y"),
    ]
    for i, part in enumerate((rows[:2], rows[2:3], rows[3:4], rows[4:])):
        write(spark, part, f"{tmp_path}/in", i)
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    left = spark.read.format("statestore").option("stateVarName", "accepted").load(f"{tmp_path}/out/checkpoint").collect()
    assert left == []


def test_emitted_documents_are_delivered_once(spark, tmp_path):
    rows = actions(7, 60)
    write(spark, rows[:60], f"{tmp_path}/in", 0)
    write(spark, rows[60:], f"{tmp_path}/in", 1)
    root = f"file://{tmp_path}/sink"
    put = sinks.batch_writer(root)

    def deliver(batch, number):
        sent = batch.where("result = 'emitted'").selectExpr(
            "scope AS owner", "key || '/' || content || '/' || pos AS key", "'s' AS source", "'d' AS destination", "content AS path",
            "pos AS updated",
        )
        for _ in range(2):  # as if the first try had been lost after it was done
            put(sent, number)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    commit.commits(stream, retention_s=4000).writeStream.foreachBatch(deliver).option(
        "checkpointLocation", f"{tmp_path}/checkpoint",
    ).trigger(availableNow=True).start().awaitTermination()
    want = sorted(pos for _, pos, result in folded(rows) if result == "emitted")
    assert sorted(r["updated"] for r in spark.read.parquet(f"{root}/documents").collect()) == want
    assert re.fullmatch("committed", "|".join({r["status"] for r in sinks.journal(spark, root).collect()}))
