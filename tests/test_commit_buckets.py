"""Commits: many scopes share the state of their bucket, and nothing else."""

from billsift.streaming import commit
from billsift.streaming.state import BUCKETS

from .test_commits import BASE, SCHEMA, folded, run, write

SCOPES = 1300


def test_many_scopes_take_no_more_groups_than_buckets(spark, tmp_path):
    """All scopes have the same names; claims come in one batch, outcomes in another, of which every third scope has none."""
    claims = [(f"s{i}", i % 50, 2 * i, "claim", i, "k", ["a"], "c") for i in range(SCOPES)] + [(None, 7, 9_000, "claim", 0, "k", None, "c")]
    ends = [(f"s{i}", 60 + i % 30, 2 * i + 1, "fail" if i % 3 == 1 else "accept", i, "k", ["a"], "c") for i in range(SCOPES) if i % 3]
    again = [(f"s{i}", 95, 10_000 + i, "claim", 5_000 + i, "z", ["k"], "c") for i in range(SCOPES)]
    rows = [*claims, *ends, *again]
    for number, part in enumerate((claims, ends, again)):
        write(spark, part, f"{tmp_path}/in", number)
    order = lambda found: sorted(found, key=lambda r: (str(r[0]), r[1]))
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    commit.commits(reader, retention_s=4000).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/out/checkpoint").outputMode(
        "append",
    ).trigger(availableNow=True).start(f"{tmp_path}/out/rows").awaitTermination()
    got = [(r["scope"], r["pos"], r["result"]) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()]
    want = {(scope, pos): result for scope, pos, result in folded([r for r in rows if r[0]])} | {(None, 9_000): "granted"}
    assert order(got) == order([(*k, v) for k, v in want.items()]) and set(want.values()) == {"granted", "emitted", "released", "busy", "seen"}
    left = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/out/checkpoint")
    assert 0 < left.select("key").distinct().count() <= BUCKETS < SCOPES


def test_actions_without_a_time_are_dropped(spark, tmp_path):
    rows = [("a", 0, 0, "claim", 0, "k", None, "c"), ("a", 10, 1, "accept", 0, "k", None, "c")]
    write(spark, rows, f"{tmp_path}/in", 0)
    spark.createDataFrame([("a", None, 2, "claim", 1, "x", None, "c"), ("a", BASE, 4, "claim", 2, "y", None, "c")], SCHEMA).coalesce(1).write.parquet(
        f"{tmp_path}/in/part=001"
    )
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out", one_by_one=False) == [("a", 0, "granted"), ("a", 1, "emitted"), ("a", 4, "granted")]
