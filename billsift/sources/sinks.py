"""Idempotent sinks: a document is delivered once, whatever is tried again.

The journal is a log of entries, in folders by the owner's bucket and by batch. A batch reads the buckets of its own
owners only, and writes what it changes twice: as pending before the documents, as committed after them. Both writes
replace their own folders, so a batch that is tried again ends as if it had been tried once. `compact` turns a bucket's
history into its last state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import views
from ..operators.numbering import written

BUCKETS = 64
LOG = "owner string, identity string, source string, destination string, path string, status string, updated long, version long, bucket int, batch long"


def _bucket(owner: str) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int")


def _log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{root}/journal")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def journal(spark: SparkSession, root: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """(owner, ENTRY): the last state of each entry, of some `buckets` and as of before a batch, if given; empty before the first delivery."""
    log = _log(spark, root)
    if buckets is not None:
        log = log.where(F.col("bucket").isin(buckets))
    if before is not None:
        log = log.where(F.col("batch") < before)
    last = log.groupBy("owner", "identity").agg(F.max_by(F.struct(*views.ENTRY[1:]), "version").alias("_last"))
    return last.where("_last.status <> 'evicted'").select("owner", "identity", "_last.*")


def _write(rows: DataFrame, root: str, batch: int, version: int) -> None:
    """Log rows as this version of theirs, in place of what an earlier try of the batch wrote."""
    rows = rows.select(
        "owner", *views.ENTRY, F.lit(version).cast("long").alias("version"), _bucket("owner").alias("bucket"),
        F.lit(batch).cast("long").alias("batch"), F.lit(version % 2).alias("step"),
    )
    rows.repartition("bucket").write.partitionBy("bucket", "batch", "step").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/journal")


def deliver(
    docs: DataFrame, root: str, batch: int, owner: str = "owner", identity: str = "key", at: str = "updated", cap: int = views.JOURNAL_CAP,
) -> DataFrame:
    """Write a batch's documents that were not delivered before, once each; receipts (owner, identity, accepted, deduped, why) come back.

    `docs` has an owner, an identity, source, destination, path and a time as a whole number, and any content. Batches are numbered
    from 1, in order. The first row (by time, then path) of an identity counts. A delivery that was prepared but not
    committed is written again, to its first path; one that the journal refuses (`supplier`, `full`) is not accepted.
    """
    spark = docs.sparkSession
    first = Window.partitionBy("owner", "identity").orderBy("updated", "path")
    named = docs.withColumns({"owner": F.col(owner).cast("string"), "identity": F.col(identity).cast("string"), "updated": F.col(at).cast("long")})
    named = written(named.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").drop("_turn"), "deliveries")
    touched = [r[0] for r in named.select(_bucket("owner")).distinct().collect()]  # BUCKETS at most
    before = written(journal(spark, root, touched, batch), "before")
    changes = views.delivery_changes(before, named.select("owner", *[c for c in views.ENTRY if c != "status"]), "owner", cap)
    _write(changes.where("outcome IN ('again', 'fresh')"), root, batch, 2 * batch)
    told = changes.where("outcome IN ('again', 'fresh')").select(
        F.col("owner").alias("_o"), F.col("identity").alias("_i"), F.col("path").alias("_path"), (F.col("status") == "committed").alias("_done"),
    )
    mine = F.col("owner").eqNullSafe(F.col("_o")) & (F.col("identity") == F.col("_i"))
    send = named.join(told.where("NOT _done"), mine).withColumn("path", F.col("_path")).drop("_o", "_i", "_path", "_done")
    send.write.mode("overwrite").parquet(f"{root}/documents/batch={batch}")
    done = changes.where("outcome = 'evicted' OR status = 'pending'")
    _write(done.withColumn("status", F.when(F.col("outcome") == "evicted", "evicted").otherwise("committed")), root, batch, 2 * batch + 1)
    sent = changes.where("outcome <> 'evicted'")
    refused = F.col("outcome").startswith("refused:")
    return sent.select(
        "owner", "identity", (~refused).alias("accepted"), F.coalesce(F.col("status") == "committed", F.lit(False)).alias("deduped"),
        F.when(refused, F.substring("outcome", 9, 20)).alias("why"),
    )


def batch_writer(root: str, **options) -> Callable[[DataFrame, int], None]:
    """`deliver` for a stream's foreachBatch: a batch that the stream repeats is delivered once."""

    def write(batch: DataFrame, number: int) -> None:
        deliver(batch, root, number + 1, **options)

    return write


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Put the batches up to `upto` of each bucket into one, `upto`; what has been evicted goes. Can be tried again at any point."""
    log = _log(spark, root).where(F.col("batch") <= upto)
    last = log.groupBy("owner", "identity").agg(F.max_by(F.struct(*views.ENTRY[1:], "version"), "version").alias("_last"))
    rows = written(last.where("_last.status <> 'evicted'").select("owner", "identity", "_last.*"), "compacted")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    here = f"{root}/journal"
    rows.withColumns(
        {"bucket": _bucket("owner"), "batch": F.lit(upto).cast("long"), "step": F.lit(2)}
    ).repartition("bucket").write.partitionBy("bucket", "batch", "step").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(here)
    for bucket in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(here)):
        if not bucket.isDirectory():
            continue
        for b in files.listStatus(bucket.getPath()):
            number = int(b.getPath().getName().partition("=")[2])
            for step in files.listStatus(b.getPath()) if number <= upto else ():
                if number < upto or step.getPath().getName() != "step=2":
                    files.delete(step.getPath(), True)
