"""Rules that need a key's rows in order, with a state that is small: rows are sorted by Spark and pass by one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship


class Fold:
    """The state of one key: `row` takes the next row's values, and both give rows of the result."""

    def row(self, *values) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[Column], make: Callable[[], Fold], ddl: str) -> DataFrame:
    """(keys, `ddl`): what a fold gives for each key's rows in `order`; `make` gives a fresh one, `values` are what it reads.

    Rows are dealt by key and sorted (spilling to disk where needed), then read as a stream: a task holds one batch and one
    fold at a time, however many rows a key has. Null keys are keys like any other.
    """
    ship(df.sparkSession)
    n = len(keys)
    named = [v.alias(f"_v{i}") for i, v in enumerate(values)]
    sorts = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    dealt = df.select(*keys, *named, *sorts).repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(sorts))]).drop(*[f"_o{i}" for i in range(len(sorts))])
    schema = T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(ddl)))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or row[:n] != key:
                    if fold is not None:
                        out += [key + tuple(x) for x in fold.end()]
                    key, fold = row[:n], make()
                out += [key + tuple(x) for x in fold.row(*row[n:])]
            if out:
                yield _batch(out, arrow)
        if fold is not None and (out := [key + tuple(x) for x in fold.end()]):
            yield _batch(out, arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Emitted(Fold):
    """Names that are held; a row is (place, names), the first of which is its key."""

    def __init__(self):
        self.held: set[str] = set()

    def row(self, place, names):
        fresh = self.held.isdisjoint(names)
        self.held.update(names if fresh else names[:1])
        return [(place,)] if fresh else ()


class Remembered(Fold):
    """A route with the one before it and its misses in a row, of which `most` forget it; a row is (route or none)."""

    def __init__(self, most: int):
        self.most, self.route, self.previous, self.misses = most, None, None, 0

    def row(self, route):
        if route is not None:
            if self.route is None or self.route != route:
                self.previous = self.route
            self.route, self.misses = route, 0
        elif self.route is not None:
            self.misses += 1
            if self.misses == self.most:
                self.route, self.previous, self.misses = self.previous, None, 0
        return ()

    def end(self):
        return [(self.route, self.previous, self.misses)] if self.route is not None else ()


class Buffered(Fold):
    """The last captures of different requests, within a number and a size; a row is (place, request, size)."""

    def __init__(self, most: int, size: int):
        self.most, self.size, self.held = most, size, []

    def row(self, place, request, size):
        self.held = [x for x in self.held if x[1] != request] + [(place, request, size)]
        while len(self.held) > self.most or sum(x[2] for x in self.held) > self.size:
            self.held.pop(0)
        return ()

    def end(self):
        return [(x[0],) for x in self.held]


class Chosen(Fold):
    """Candidates in order: `most` of them, whose origins together are no more than `most_origins`; a row is (candidate, origins)."""

    def __init__(self, most: int, most_origins: int):
        self.most, self.most_origins, self.n, self.origins = most, most_origins, 0, set()

    def row(self, candidate, origins):
        union = self.origins.union(origins or ())
        if self.n == self.most or len(union) > self.most_origins:
            return ()
        self.n, self.origins = self.n + 1, union
        return [(candidate, self.n - 1)]
