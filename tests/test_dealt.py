"""Rows dealt by their number: the tasks of a big input are more, not bigger."""

from pyspark.sql import functions as F

from billsift import queries_admission
from billsift.session import dealt


def test_tasks_grow_in_number(spark):
    df = spark.range(2000).withColumn("k", F.col("id") % 300)
    out = dealt(df, "k", rows=100)
    assert out.rdd.getNumPartitions() == 20 and out.count() == 2000
    placed = out.select("k", F.spark_partition_id().alias("p")).distinct()
    assert placed.count() == 300  # a key lies in one task
    assert dealt(df, "k", rows=10_000).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_previews_sort_lines_where_they_are_dealt(spark, sf_dir):
    """All that is done to a line happens in the tasks it was dealt to: no later shuffle that fewer tasks could read."""
    plan = queries_admission.candidate_previews(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 1
    assert not any("ENSURE_REQUIREMENTS" in line and "l_orderkey" in line for line in plan.splitlines())
