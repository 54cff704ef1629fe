"""What a batch does to the journal is worked out once, however many of its parts are asked for."""

import pytest
from pyspark.sql import functions as F

from billsift.operators import views

NEW = "owner string, identity string, source string, destination string, path string, updated long"


@pytest.mark.parametrize("cap, outcomes", [(500, {"fresh", "again", "refused:supplier"}), (3, {"fresh", "again", "refused:full", "evicted", "refused:supplier"})])
def test_each_delivery_is_looked_at_once(spark, cap, outcomes):
    looked = spark.sparkContext.accumulator(0)

    def look(x):
        looked.add(1)
        return x

    entries = [("a", "i0", "s", "d", "p0", "committed", 1), ("a", "i1", "s", "d", "p1", "pending", 2), ("a", "i2", "s", "d", "p2", "pending", 3), ("a", "i3", "s", "d", "p3", "committed", 4)]
    journal = spark.createDataFrame(entries, f"owner string, {', '.join(f'{c} {"long" if c == "updated" else "string"}' for c in views.ENTRY)}")
    rows = [("a", "i1", "s", "d", "q", 9), ("a", "i2", "t", "d", "q", 9), *[("a", f"n{i}", "s", "d", f"q{i}", 10 + i) for i in range(6)]]
    new = spark.createDataFrame(rows, NEW).repartition(2).withColumn("path", F.udf(look, "string")("path"))
    got = {r["identity"]: (r["outcome"], r["path"], r["status"]) for r in views.delivery_changes(journal, new, "owner", cap).collect()}
    assert {outcome for outcome, _, _ in got.values()} == outcomes and got["i1"] == ("again", "p1", "pending") and got["i2"][0] == "refused:supplier"
    assert looked.value == len(rows)
