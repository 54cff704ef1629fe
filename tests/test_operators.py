"""Small cases of operators, recipes, scans, sinks and streams."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from billsift import queries
from billsift.functions import transforms, values
from billsift.operators import evidence, identity, ledger, outcomes, ranking, retrieval, views
from billsift.plans import recipe
from billsift.sources import scans, sinks
from billsift.streaming import state


def one(spark, column, **values_):
    row = spark.createDataFrame([tuple(values_.values())], list(values_)) if values_ else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_evidence(spark):
    claims = [(1, "INV-9", 2), (1, "INV-9", 2), (1, "INV-8", 2), (2, "a", 3), (2, "b", 3), (3, None, 3), (4, "low", 1), (4, "high", 3)]
    rows = evidence.resolve(spark.createDataFrame(claims, "k int, value string, weight int"), ["k"]).collect()
    assert {r["k"]: (r["value"], r["conflict"]) for r in rows} == {1: ("INV-9", False), 2: (None, True), 4: ("high", False)}


def test_identity_vector(spark):
    key = values.identity_key(F.lit("local"), F.lit("ext:x"), F.lit("in_1"))
    assert one(spark, key) == "38d8e328c093a92b11af9978436bc397531f0672043d5d12906dbb6cc138f189"


def test_aliases_are_no_closure(spark):
    refs = [(0, 0, "k1", []), (0, 1, "k2", ["k1", "k3"]), (0, 2, "k2", []), (0, 3, "k3", []), (0, 4, "k4", []), (1, 0, "k1", None)]
    df = spark.createDataFrame(refs, "v int, pos int, key string, aliases array<string>")
    assert sorted((r["v"], r["key"]) for r in identity.emitted_once(df, ["v"]).collect()) == [(0, "k1"), (0, "k3"), (0, "k4"), (1, "k1")]


def test_upsert_keeps_the_earliest(spark):
    schema = "k int, at int, name string, tags array<string>"
    old, new = spark.createDataFrame([(1, 5, "a", ["x"]), (2, 1, "b", None)], schema), spark.createDataFrame(
        [(1, 7, None, ["x", "y"]), (3, 2, "c", [])], schema,
    )
    rows = {r["k"]: tuple(r)[1:] for r in ledger.upsert(old, new, ["k"], ["at"], ["tags"]).collect()}
    assert rows == {1: (5, "a", ["x", "y"]), 2: (1, "b", []), 3: (2, "c", [])}


@pytest.mark.parametrize("termination, observed, resolved, unresolved, want", [
    (
        "explicit_end", 1, 1, 0, ("complete", 1, 0),
    ), ("stable_end", 0, 0, 0, ("complete", 0, 0)), ("page_cap", 1, 1, 0, ("partial", 1, 0)), ("explicit_end", 3, 2, 1, ("partial", 2, 1)),
    ("explicit_end", 1, 2, 0, ("partial", 0, 1)), ("explicit_end", 10_001, 10_000, 0, ("partial", 0, 10_000)), ("explicit_end", None, 0, 0, ("partial", 0, 0)),
])
def test_proof(spark, termination, observed, resolved, unresolved, want):
    df = spark.createDataFrame([(termination, observed, resolved, unresolved)], "t string, o long, r long, u long")
    row = retrieval.proof(df, F.col("t"), F.lit(1), F.col("o"), F.col("r"), F.col("u")).first()
    assert (row["completeness"], row["resolved_items"], row["unresolved_items"]) == want


def test_walk(spark):
    pages = [
        ("end", 0, True, "a"), ("end", 1, False, None), ("loop", 0, True, "a"), ("loop", 1, True, "a"), ("fail", 0, True, " "),
        ("gone", 0, True, "z"), ("cap", 0, True, "a"), ("cap", 1, True, "b"), ("cap", 2, True, "c"), ("cap", 3, False, ""),
    ]
    df = spark.createDataFrame(pages, "s string, seq int, more boolean, state string")
    rows = retrieval.walked(df, "s", "seq", F.col("more"), F.col("state"), F.lit(1), 3).collect()
    assert {r["s"]: (r["termination"], r["n_pages"]) for r in rows} == {
        "end": ("explicit_end", 2), "loop": ("repeated_state", 2), "fail": ("continuation_failed", 1), "gone": ("continuation_failed", 1),
        "cap": ("page_cap", 3),
    }


def test_scopes_are_bounded(spark):
    many = spark.createDataFrame([(0, "a", str(i)) for i in range(51)], "k int, o string, v string")
    with pytest.raises(Exception, match="over 50 values"):
        retrieval.scopes(many, ["k"], "o", "v", ["v"]).collect()


def test_frontier_takes_turns(spark):
    rows = [("a1", "link", "a", 9), ("a2", "link", "a", 8), ("b1", "link", "b", 1), ("r", "remembered", "a", 0), ("c", "common_route", "b", 0)]
    df = spark.createDataFrame([(0, *r) for r in rows], "k int, url string, source string, family string, score int")
    assert [r["url"] for r in ranking.frontier(df, ["k"]).orderBy("rank").collect()] == ["r", "c", "a1", "b1", "a2"]


def test_budget_skips_and_goes_on(spark):
    assert one(spark, ranking.within_budget(F.array(*map(F.lit, (5, 9, 4, 1))), 10)) == [True, False, True, True]


def test_route_memory(spark):
    # route a, then b; three misses fall back to a; three more forget it
    def fold(events):
        df = spark.createDataFrame([(0, i, e, e is not None) for i, e in enumerate(events)], "k int, at int, route string, ok boolean")
        return [(r["route"], r["previous"], r["misses"]) for r in outcomes.route_memory(df, ["k"], ["at"], "route", F.col("ok")).collect()]

    assert fold([None, "a", None, "b"]) == [("b", "a", 0)]
    assert fold(["a", "b", None, None, None]) == [("a", None, 0)]
    assert fold(["a", "b", *[None] * 6]) == []


def test_transforms(spark):
    apply = lambda text, *steps: one(spark, transforms.applied(F.lit(text), steps))
    assert apply("4900", {"kind": "divide", "by": 100}) == "49.00"
    assert apply("x", {"kind": "divide", "by": 100}) == "x"
    assert apply("2026-06-30T10:00:00Z", {"kind": "date"}) == "2026-06-30"
    assert apply("invoice_776", {"kind": "regex", "pattern": r"_(\d+)$", "group": 1}) == "776"
    assert apply("aXbX", {"kind": "replace", "pattern": "X", "with": "-"}) == "a-bX"
    assert apply("x" * 16_385, {"kind": "regex", "pattern": "x"}) is None


def test_recipe(spark):
    body = json.dumps(
        {
            "data": {
                "invoices": [{"id": "in_1", "total": 4762, "end": "2026-06-14T00:00:00Z"}, {"id": " ", "total": 1}, {"id": "in_2", "total": 2000, "end": None}]
            }
        }
    )
    E = recipe.Extract
    shape = recipe.Recipe(
        "rail", "json", "data.invoices",
        {"id": E("id"), "total": E("total", [{"kind": "divide", "by": 100}]), "issuedAt": E("end", [{"kind": "date"}])},
    )
    found, bad = recipe.refs(shape, spark.createDataFrame([(1, body), (2, "{no json"), (3, None)], "src int, body string"))
    assert [(r["id"], r["total"], r["issuedAt"]) for r in found.orderBy("pos").collect()] == [("in_1", "47.62", "2026-06-14"), ("in_2", "20.00", None)]
    assert [(r["pos"], r["cause"]) for r in bad.collect()] == [(1, "schema_invalid")]


@pytest.mark.parametrize("pattern", [r"(a+)+", r"(a)\1", r"(?=a)", r"a{101}", "("])
def test_unsafe_patterns(pattern):
    with pytest.raises(recipe.RecipeError):
        recipe.check_pattern(pattern)


def test_document_links(spark):
    html = '<title>Billing history</title><script>"<a href=\'/x.pdf\'>"</script><a href="/i/1.pdf">One</a><a href="http://o.example.com/2.pdf">plain</a><a href="/terms.pdf">Terms</a><a href="/about">Us</a>'
    df = spark.createDataFrame([(html, "https://a.example.com/b")], "html string, base string")
    assert [r["link"] for r in scans.document_links(df, "html", "base").collect()] == ["https://a.example.com/i/1.pdf"]


def test_private_data(spark):
    text = "pay 4111 1111 1111 1111 or SE4550000000058398257466, mail a.b@c.example"
    assert one(spark, values.card_numbers(F.lit(text))) == ["4111111111111111"]
    assert one(spark, values.ibans(F.lit(text))) == ["SE4550000000058398257466"]
    token, other = "A" * 24, "B" * 30
    assert one(spark, values.aliased_tokens(F.lit(f"{token} {other} {token}"))) == "REDACTED_VALUE_1 REDACTED_VALUE_2 REDACTED_VALUE_1"
    assert "user@example.com" in one(spark, values.redacted(F.lit(text)))


def deliveries(spark, *rows):
    return spark.createDataFrame(
        [(o, k, s, d, p, t, f"doc {p}") for o, k, s, d, p, t in rows],
        "owner string, key string, source string, destination string, path string, updated long, text string",
    )


def told(receipts):
    return {(r["owner"], r["identity"]): (r["accepted"], r["deduped"], r["why"]) for r in receipts.collect()}


def test_delivery_is_idempotent(spark, tmp_path):
    root = f"file://{tmp_path}/sink"
    one = deliveries(spark, ("o", "a", "s", "d", "pa", 1), ("o", "b", "s", "d", "pb", 2), ("o", "a", "s", "d", "later", 3))
    fresh, again = (True, False, None), (True, True, None)
    for _ in range(2):  # the second time is the same batch, tried again
        assert told(sinks.deliver(one, root, 1)) == {("o", "a"): fresh, ("o", "b"): fresh}
    two = deliveries(
        spark, ("o", "a", "s", "d", "new", 9), ("o", "b", "s", "d2", "pb2", 9), ("o", "c", "s", "d", "pc", 9), ("p", "a", "s", "d", "x", 9),
        ("o", "b", "t", "d", "y", 10),
    )
    for _ in range(2):
        assert told(sinks.deliver(two, root, 2)) == {("o", "a"): again, ("o", "b"): fresh, ("o", "c"): fresh, ("p", "a"): fresh}
    assert sorted(r["path"] for r in spark.read.parquet(f"{root}/documents").collect()) == ["pa", "pb", "pb2", "pc", "x"]
    assert told(sinks.deliver(deliveries(spark, ("o", "a", "t", "d", "z", 11)), root, 3)) == {("o", "a"): (False, False, "supplier")}
    assert {r["identity"]: r["path"] for r in sinks.journal(spark, root).where("owner = 'o'").collect()} == {"a": "pa", "b": "pb2", "c": "pc"}


def test_delivery_after_a_lost_commit(spark, tmp_path, monkeypatch):
    """What was written but not committed is written again, to the same path."""
    root = f"file://{tmp_path}/sink"
    real = sinks._write

    def fails(rows, root, batch, version):
        if version % 2:
            raise RuntimeError("no commit")
        real(rows, root, batch, version)

    monkeypatch.setattr(sinks, "_write", fails)
    with pytest.raises(RuntimeError):
        sinks.deliver(deliveries(spark, ("o", "a", "s", "d", "first", 1)), root, 1)
    monkeypatch.setattr(sinks, "_write", real)
    assert [r["status"] for r in sinks.journal(spark, root).collect()] == ["pending"]
    assert told(sinks.deliver(deliveries(spark, ("o", "a", "s", "d", "second", 2)), root, 2)) == {("o", "a"): (True, False, None)}
    assert [r["path"] for r in spark.read.parquet(f"{root}/documents/batch=2").collect()] == ["first"]
    assert told(sinks.deliver(deliveries(spark, ("o", "a", "s", "d", "third", 3)), root, 3)) == {("o", "a"): (True, True, None)}


def test_journal_keeps_its_cap_and_reads_its_own_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/sink"
    sinks.deliver(deliveries(spark, *[("o", f"a{i}", "s", "d", f"a{i}", i) for i in range(5)], ("q", "z", "s", "d", "z", 1)), root, 1, cap=4)
    assert sorted(r["identity"] for r in sinks.journal(spark, root).where("owner = 'o'").collect()) == ["a0", "a1", "a2", "a3"]
    found = told(
        sinks.deliver(deliveries(spark, *[("o", f"b{i}", "s", "d", f"b{i}", 10 + i) for i in range(6)], ("o", "a3", "s", "d", "x", 20)), root, 2, cap=4)
    )
    assert {k for (_, k), (ok, *_) in found.items() if not ok} == {"b3", "b4", "b5"} and found["o", "a3"] == (True, True, None)
    state = lambda: sorted((r["owner"], r["identity"], r["status"]) for r in sinks.journal(spark, root).collect())
    want = [("o", "a3", "committed"), ("o", "b0", "committed"), ("o", "b1", "committed"), ("o", "b2", "committed"), ("q", "z", "committed")]
    assert state() == want
    for _ in range(2):
        sinks.compact(spark, root, 2)
        assert state() == want
    folders = [p.name for p in (tmp_path / "sink/journal").glob("bucket=*/batch=*/step=*")]
    assert set(folders) == {"step=2"}
    plan = sinks.journal(spark, root, [3], 7)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket[^]]*batch", plan)
    assert told(sinks.deliver(deliveries(spark, ("o", "b0", "s", "d", "x", 30)), root, 3, cap=4)) == {("o", "b0"): (True, True, None)}


def test_journal_conflicts_and_foreign_entries(spark):
    entry = "owner string, identity string, source string, destination string, path string, status string, updated long"
    old = spark.createDataFrame(
        [
            ("o", "a", "s", "d", "p", "pending", 1), ("o", "b", "s", "d", "p", "committed", 2), (None, "a", "s", "d", "p", "pending", 3),
            ("o", "old", None, "d", "p", "committed", 4),
        ],
        entry,
    )
    new = spark.createDataFrame(
        [("o", "b", "t", "d", "n", 9), (None, "a", "s", "d", "n", 9), ("o", "old", "s", "d", "n", 9)],
        "owner string, identity string, source string, destination string, path string, updated long",
    )
    journal, refused = views.prepare_deliveries(old, new, "owner")
    assert [tuple(r) for r in refused.collect()] == [("o", "b", "supplier")]
    assert sorted(map(repr, map(tuple, journal.collect()))) == sorted(
        map(
            repr,
            [
                ("o", "a", "s", "d", "p", "pending", 1), ("o", "b", "s", "d", "p", "committed", 2), (None, "a", "s", "d", "p", "pending", 3),
                ("o", "old", "s", "d", "p", "committed", 4),
            ],
        )
    )
    done = spark.createDataFrame(
        [("o", "a", "d", "other", 5), ("o", "x", "d", "p", 5), (None, "a", "d", "p", 5)],
        "owner string, identity string, destination string, path string, updated long",
    )
    after, conflicts = views.commit_deliveries(old, done, "owner")
    assert sorted(map(tuple, conflicts.collect())) == [("o", "a", "changed"), ("o", "x", "missing")]
    assert {(r["owner"], r["identity"]): r["status"] for r in after.collect()} == {
        ("o", "a"): "pending", ("o", "b"): "committed", (None, "a"): "committed", ("o", "old"): "committed",
    }


@pytest.mark.parametrize("files", [1, 3])
def test_leases_end(spark, tmp_path, files):
    """However the stream is cut into batches, an event is kept if and only if a lease since the last kept one of its key has passed."""
    import random

    rng = random.Random(files)
    base = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    rows = sorted((rng.choice("abc"), s, i) for i, s in enumerate(rng.randrange(6000) for _ in range(300)))
    rows += [("d", s, 1000 + s) for s in (0, 299, 300, 301, 600, 900, 9000)]
    kept, until = set(), {}
    for key, s, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if s >= until.get(key, 0):
            kept.add(i)
            until[key] = s + 300
    rows.sort(key=lambda r: (r[1], r[2]))
    for k in range(files):
        part = rows[len(rows) * k // files : len(rows) * (k + 1) // files]
        spark.createDataFrame(
            [(key, base + dt.timedelta(seconds=s), i) for key, s, i in part], "key string, ts timestamp, id long",
        ).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("key string, ts timestamp, id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    run = state.leased(stream, ["key"], ties=["id"]).writeStream.format("memory").queryName(f"leases{files}").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = [r["id"] for r in spark.table(f"leases{files}").collect()]
    assert len(got) == len(kept) and set(got) == kept


def test_lease_query(spark, sf_dir):
    until, kept = {}, set()
    rows = [(r["user_id"], r["event_type"], r["ts"].timestamp(), r["event_id"]) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()]
    for user, kind, at, i in sorted(rows):
        if at >= until.get((user, kind), 0):
            kept.add(i)
            until[user, kind] = at + 300
    got = [r["event_id"] for r in queries.stream_dedup_lease(spark, sf_dir).collect()]
    assert len(got) == len(kept) and set(got) == kept


def test_lease_query_is_a_table_of_files(spark, sf_dir):
    """The stream's rows are in the shared folder, not in the driver's memory."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    files = queries.stream_dedup_lease(spark, sf_dir).inputFiles()
    assert files and all(f.removeprefix("file://").startswith(shared) for f in files)


def test_folds_of_hot_keys(spark):
    """One key has a third of all rows, over many batches; results are those of plain Python."""
    import random

    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else f"k{i % 700}", i, f"n{rng.randrange(400)}", [f"n{rng.randrange(4000)}"], rng.randrange(100_000)) for i in range(60_000)]
    df = spark.createDataFrame(rows, "k string, pos long, key string, aliases array<string>, size long").repartition(5)
    held: dict = {}
    want = []
    for k, pos, key, aliases, _ in rows:
        names = held.setdefault(k, set())
        if names.isdisjoint([key, *aliases]):
            want.append((k, pos))
            names.update([key, *aliases])
        else:
            names.add(key)
    assert sorted((r["k"], r["pos"]) for r in identity.emitted_once(df, ["k"]).collect()) == sorted(want)
    buffers: dict = {}
    for k, pos, key, _, size in rows:
        b = buffers[k] = [x for x in buffers.get(k, []) if x[1] != key] + [(pos, key, size)]
        while len(b) > 12 or sum(x[2] for x in b) > 768_000:
            b.pop(0)
    assert sorted(
        (r["k"], r["pos"]) for r in views.capture_buffer(df, ["k"], "pos", "key", "size").collect()
    ) == sorted((k, x[0]) for k, b in buffers.items() for x in b)
    memory: dict = {}
    for k, pos, key, _, size in rows:
        route, previous, misses = memory.get(k, (None, None, 0))
        if size % 4 == 0:
            memory[k] = (key, route if route != key else previous, 0)
        elif route is not None:
            memory[k] = (previous, None, 0) if misses == 2 else (route, previous, misses + 1)
    found = outcomes.route_memory(df, ["k"], ["pos"], "key", F.col("size") % 4 == 0).collect()
    assert sorted(map(tuple, found)) == sorted((k, *m) for k, m in memory.items() if m[0] is not None)


def test_folds_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, "a", None), (None, 2, "a", ["b"]), ("x", 1, "b", ["b"])], "k string, pos long, key string, aliases array<string>")
    # a null scope joins nothing, so its refs are not folded and none is lost
    assert sorted((str(r["k"]), r["pos"]) for r in identity.emitted_once(df, ["k"]).collect()) == [("None", 1), ("None", 2), ("x", 1)]
    assert identity.emitted_once(df.limit(0), ["k"]).collect() == [] == views.capture_buffer(
        df.limit(0).withColumn("size", F.lit(1)), ["k"], "pos", "key", "size",
    ).collect()
