"""A session with the settings that the operators expect."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, as `--py-files` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        held = tempfile.mkdtemp(prefix="billsift-")
        with zipfile.ZipFile(f"{held}/billsift.zip", "w") as out:
            for p in sorted((root / "billsift").rglob("*.py")):
                out.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(f"{held}/billsift.zip")
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one of this machine where it is unset and all tasks run here (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="billsift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores, for work that is heavy for the size of its rows: a small file is read by few tasks, or one."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def dealt(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """`df` dealt by `keys`, so that a task gets about `rows` rows at any size of `df`, whose rows are counted for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def session(app: str = "billsift", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed-join splitting; `conf` adds or overrides (dots as `__`)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
