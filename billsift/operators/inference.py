"""Schema inference over unknown JSON: leaves, arrays that look like invoices, units."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship

MAX_DEPTH, ARRAY_DEPTH = 8, 6
LEAF = "array<struct<list:string,pos:bigint,path:string,key:string,kind:string,value:string>>"
# What the names of fields say.
MONEY, DATE, IDENT, DOCUMENT = r"(?i)amount|total|price|gross|net|sum|cents", r"(?i)date|issued|created|period|time", r"(?i)(?:^|_)id$|Id$|number|uuid", r"(?i)url|pdf|link|download|href"


def _walk(value, path: str, key: str, depth: int) -> Iterator[tuple]:
    """(list, pos, path, key, kind, value) of each scalar; a list of objects starts paths of its own."""
    if isinstance(value, dict):
        if depth < MAX_DEPTH:
            for k, v in value.items():
                yield from _walk(v, f"{path}.{k}" if path else k, k, depth + 1)
    elif isinstance(value, list):
        if depth <= ARRAY_DEPTH and value and all(isinstance(x, dict) for x in value):
            for i, x in enumerate(value):
                for _, _, inner, k, kind, v in _walk({a: b for a, b in x.items() if not isinstance(b, list)}, "", "", depth + 1):
                    yield path or "$", i, inner, k, kind, v
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        yield None, None, path, key, kind, None if value is None else value if isinstance(value, str) else json.dumps(value)


def leaves(df: DataFrame, body: str) -> DataFrame:
    """`df` without `body`, with (list, pos, path, key, kind, value): one row for each scalar, within MAX_DEPTH levels.

    A scalar inside an array of objects carries the array's path and its place in it. A body that is no JSON has no rows.
    """
    ship(df.sparkSession)
    kind = T.StructType.fromDDL(f"x {LEAF}")["x"].dataType
    names = kind.elementType.fieldNames()

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                try:
                    rows = list(_walk(json.loads(text), "", "", 0)) if text else []
                except (ValueError, RecursionError):
                    rows = []
                out.append([dict(zip(names, r)) for r in rows])
            yield pa.array(out, type=to_arrow_type(kind))

    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.explode(run(body)).alias("_leaf")).select(*rest, "_leaf.*")


def array_scores(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, list, n_items, score): the share of an array's items that have a date and an amount, or a date, an id and a document."""
    on = lambda pattern, test=None: F.max(
        (F.col("key").rlike(pattern) & F.col("value").isNotNull() & (F.lit(True) if test is None else test)).cast("int")
    )
    dated = F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}|^\d{10}(?:\d{3})?$")
    items = found.where("list IS NOT NULL").groupBy(*keys, "list", "pos").agg(
        on(DATE, dated).alias("d"), on(MONEY, F.col("value").rlike(r"^-?\d+(?:\.\d+)?$")).alias("m"), on(IDENT).alias("i"), on(DOCUMENT).alias("u")
    )
    good = F.col("d") * F.greatest(F.col("m"), F.col("i") * F.col("u"))
    return items.groupBy(*keys, "list").agg(F.count("*").alias("n_items"), F.avg(good).alias("score"))


def best_array(scores: DataFrame, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """The array of the best score of each key, if it is `least` or more: more items, then the lesser path in a tie."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("n_items").desc(), "list")
    return scores.where(F.col("score") >= least).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def minor_units(value: Column, key: Column) -> Column:
    """Whether a number is likely in hundredths: its name says so, or it is a whole number of three digits or more."""
    return F.coalesce(key.rlike(r"(?i)cents|minor") | value.rlike(r"^\d{3,}$"), F.lit(False))
