"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table
(an offset and a stride taken from MD5 of its name). The shards take turns; on
its turn a shard claims the first slot of its order that is still free, until
the table is full. Every shard then holds the same number of slots, give or
take one, and a change of the shard list moves few slots beyond those that
must move. The table's size depends on the number of shards alone, so it is
broadcast; a row is placed by one hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS_PER_SHARD = 100
MAX_SHARDS = 10_000
NULL_KEY = "\x00"
PRODUCTION_SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def prime_from(n: int) -> int:
    """The smallest prime that is n or more."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int | None = None) -> list[int]:
    """Slot -> index of the shard that claimed it.

    Raises ValueError on no, too many or repeated names, or a size that is not a prime of at least as many slots as shards.
    """
    n = len(shards)
    if not 0 < n <= MAX_SHARDS or len(set(shards)) < n:
        raise ValueError(f"from 1 to {MAX_SHARDS} different shard names are needed")
    size = prime_from(n * SLOTS_PER_SHARD) if size is None else size
    if size < n or prime_from(size) != size:
        raise ValueError("the table's size must be a prime, and no less than the number of shards")
    at = [_number("offset:" + s) % size for s in shards]
    stride = [_number("stride:" + s) % max(size - 1, 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i in range(n):
            while table[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(keys: Sequence[Column], size: int) -> Column:
    """The slot of a row: MD5 of its keys. A null key counts as a value of its own."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit(NULL_KEY)) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size))


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str] = PRODUCTION_SHARDS, size: int | None = None, into: str = "shard") -> DataFrame:
    """`df` with the columns `<into>` and `<into>_slot`.

    Equal keys (repeated rows too) get the same shard, null keys one like any other value, an
    empty table stays empty. Input columns of the two names are replaced, keys too. Rows are balanced as
    far as their keys are: give a key with many values (an id), not one with a hot value.
    """
    table = lookup_table(shards, size)
    slot = f"{into}_slot"
    names = {into.lower(), slot.lower()}
    at, found, name = (f"_{x}_{len(df.columns)}" for x in ("slot", "found", "name"))
    lookup = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], f"`{found}` long, `{name}` string")
    placed = df.withColumn(at, slot_of([df[k] for k in keys], len(table))).join(F.broadcast(lookup), F.col(at) == F.col(found), "left")
    return placed.select(*[df[c] for c in df.columns if c.lower() not in names], F.col(at).alias(slot), F.col(name).alias(into))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, ["doc_id"]).select("doc_id", "shard_slot", "shard")


def oracle_sql(shards: int = len(PRODUCTION_SHARDS)) -> str:
    """The same for the production shards: the turns are a recursion, each step one claim."""
    size = prime_from(shards * SLOTS_PER_SHARD)
    return rf"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range({shards}) t(i)),
prefs AS MATERIALIZED (
  SELECT list(('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {size} ORDER BY i) AS o,
         list(('0x' || substr(md5('stride:' || name), 1, 15))::BIGINT % {size - 1} + 1 ORDER BY i) AS s FROM shards),
turns(step, slot, taken) AS (
  SELECT 0::BIGINT, NULL::BIGINT, bitstring('0', {size}) FROM prefs
  UNION ALL
  SELECT step + 1, pick, set_bit(taken, pick::INTEGER, 1)
  FROM (SELECT step, taken,
               list_filter(list_transform(range({size}), lambda j: (o[step % {shards} + 1] + j * s[step % {shards} + 1]) % {size}),
                           lambda x: get_bit(taken, x::INTEGER) = 0)[1] AS pick
        FROM turns, prefs WHERE step < {size})),
placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT % {size} AS shard_slot FROM documents)
SELECT p.doc_id, p.shard_slot, s.name AS shard
FROM placed p JOIN turns t ON t.slot = p.shard_slot JOIN shards s ON s.i = (t.step - 1) % {shards}
"""
