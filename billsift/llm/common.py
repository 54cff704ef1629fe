"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..session import shared_dir, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def text_udf(make: Callable[[], Callable], ddl: str):
    """An Arrow UDF over one text column that returns the struct `ddl`.

    `make()` runs once in each task and gives the function from a text (or None)
    to a tuple of the struct's fields, so models are built once a task.
    """
    ship(SparkSession.getActiveSession())
    kind = struct_of(ddl)
    arrow = to_arrow_type(kind)
    names = kind.fieldNames()

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            rows = [one(text) for text in batch.to_pylist()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.StructArray.from_arrays(
                [pa.array(list(c), type=arrow.field(i).type) for i, c in enumerate(columns)], fields=list(arrow)
            )

    return run


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], ddl: str) -> DataFrame:
    """`df.mapInArrow`, with `make()` run once a task; it turns a batch into dicts of column lists."""
    ship(df.sparkSession)
    schema = to_arrow_schema(struct_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for columns in each(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
                )
        for columns in getattr(each, "rest", lambda: ())():
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table to the shared folder and read again: a cut in the lineage that lives through lost executors."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all members of groups that begin at `start` and have `size` members, one group after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have."""
    names = {c.lower() for c in df.columns}
    while base in names:
        base += "_"
    return base


def lines_sha256(items: Column) -> Column:
    """Lowercase hex SHA-256 of an array of strings, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
