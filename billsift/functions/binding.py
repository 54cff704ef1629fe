"""Values that are computed once, however often a rule reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """What `then` makes of a value. An expression that stands in another several times is written, and may be run, as often; this one is there once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
