"""Exactly-once commit of documents in a stream: claims, acceptance and release, with state that expires.

Actions of a scope come in order of time. A claim asks for all of a document's identities at once; it is granted if none
of them was accepted or is held by another claim. An acceptance emits the document and makes its identity and content
accepted; content that was accepted before is not emitted again, but its new identity is. A failure gives the claim back.
Claims end with their lease, acceptances with their retention; timers take out of the state what has ended.
Scopes share the state and the Python calls of their bucket by hash; in it, each name is held with its scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .state import BUCKETS

LEASE_S, RETENTION_S, MAX_ALIASES = 300, 90 * 86_400, 4
CONTENT = "content:"
OUT = "scope string, pos long, action string, key string, content string, result string"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed collections and timers need; for queries that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Commits(StatefulProcessor):
    def __init__(self, lease_s: int, retention_s: int):
        self.lease, self.retention = lease_s * 1_000_000, retention_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getMapState("accepted", "scope string, name string", "until long")
        self.held = handle.getListState("held", "scope string, name string, claim long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "pos"], kind="stable")
        held: dict[str, dict[str, tuple[int, int]]] = {}
        for scope, name, claim, until in self.held.get() if self.held.exists() else ():
            held.setdefault(scope, {})[name] = (claim, until)
        known: dict[tuple[str, str], int] = {}
        changed: set[tuple[str, str]] = set()
        stored = self.accepted.exists()

        def is_accepted(name: tuple[str, str], at: int) -> bool:
            if name not in known:
                known[name] = self.accepted.getValue(name)[0] if stored and self.accepted.containsKey(name) else -1
            return known[name] > at

        def accept(name: tuple[str, str], at: int) -> None:
            known[name] = at + self.retention
            changed.add(name)

        def decide(scope: str, at: int, action: str, claim: int, identity: str, aliases: list[str], content: str) -> str:
            ours = held.setdefault(scope, {})
            if action == "claim":
                names = list(dict.fromkeys([identity, *aliases[:MAX_ALIASES]]))
                seen = next((n for n in names if is_accepted((scope, n), at)), None)
                if seen is not None:
                    if seen != identity:
                        accept((scope, identity), at)
                    return "seen"
                if any(n in ours and ours[n][0] != claim and ours[n][1] > at for n in names):
                    return "busy"
                ours.update((n, (claim, at + self.lease)) for n in sorted(names))
                return "granted"
            mine = [n for n, (c, until) in ours.items() if c == claim and until > at]
            for n in mine:
                del ours[n]
            if not mine:
                return "expired"
            if action == "fail":
                return "released"
            repeated = is_accepted((scope, CONTENT + content), at)
            accept((scope, identity), at)
            if not repeated:
                accept((scope, CONTENT + content), at)
            return "repeated" if repeated else "emitted"

        out, last = [], {}
        for r in frame.itertuples():
            aliases = [] if r.aliases is None else list(r.aliases)
            out.append((r.scope, r.pos, r.action, r.key, r.content, decide(r.scope, r.at, r.action, r.claim, r.key, aliases, r.content)))
            last[r.scope] = r.at
        for name in changed:
            self.accepted.updateValue(name, (known[name],))
        now = timerValues.getCurrentWatermarkInMs() * 1000  # what comes later is after it
        left = [
            (scope, n, c, until) for scope, ours in held.items() for n, (c, until) in ours.items()
            if until > now and until > last.get(scope, 0) - self.lease
        ]
        if left:
            self.held.put(left)
        else:
            self.held.clear()
        if not next(iter(self.handle.listTimers()), None):
            self.handle.registerTimer((max(last.values()) + self.retention) // 1000 + 1)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        left = 0
        for name, (until,) in list(self.accepted.iterator()):
            if until <= now:
                self.accepted.removeKey(name)
            else:
                left = max(left, until)
        if self.held.exists():
            rest = [x for x in self.held.get() if x[-1] > now]
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        if left:
            self.handle.registerTimer(left // 1000 + 1)
        return iter(())

    def close(self) -> None:
        pass


def commits(actions: DataFrame, late_s: int = 0, lease_s: int = LEASE_S, retention_s: int = RETENTION_S) -> DataFrame:
    """What becomes of a stream of actions: OUT, one row for each, the emitted documents among them.

    `actions` has scope (string), ts, pos (whole number, unique in a scope), action (`claim`, `accept` or `fail`), claim (a number that an
    outcome shares with its claim), key, aliases (array, the first 4 count) and content. Results: a claim is `granted`, `seen` (accepted
    before, by any name) or `busy`; an acceptance `emitted`, `repeated` (its content was emitted before) or `expired`; a failure `released` or
    `expired`. Actions of one batch are taken by ts, then pos, so results do not depend on how an ordered stream is cut;
    actions without a time are dropped. A bucket's actions of one batch, of 1,024 buckets of scopes, are gathered in one task.
    """
    ship(actions.sparkSession)
    keep_state_in_rocksdb(actions.sparkSession)
    text = lambda c: F.col(c).cast("string").alias(c)
    named = actions.where("ts IS NOT NULL").withWatermark("ts", f"{late_s} seconds").select(
        text("scope"), "ts", F.unix_micros("ts").alias("at"), F.col("pos").cast("long").alias("pos"), text("action"), F.col("claim").cast("long").alias("claim"), text("key"),
        F.col("aliases").cast("array<string>").alias("aliases"), F.coalesce(text("content"), F.lit("")).alias("content"),
    )
    bucketed = named.withColumn("bucket", F.pmod(F.xxhash64("scope"), F.lit(BUCKETS)))
    return bucketed.groupBy("bucket").transformWithStateInPandas(_Commits(lease_s, retention_s), OUT, "Append", "EventTime")
