"""Session settings the library relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# All of these can be changed on a running session; sizes such as the number of
# shuffle partitions stay with whoever runs the cluster (AQE coalesces them).
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins against small aggregated sides hash those instead of sorting wide rows,
    # where every partition of the small side is measured to fit.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Shuffle files go when their job ends, not when the driver next collects garbage: what
    # writes table after table would else keep the shuffles of all of them.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; a no-op when they are already in place."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# Readers deal their rows over this many partitions when it is set, whatever the size of the
# table: for files of few row groups, whose one task would otherwise parse everything. Unset
# by default, as large tables have splits enough.
READER_PARTITIONS = "orderlens.readers.partitions"


def spread(df: DataFrame, partitions: int | str | None = None) -> DataFrame:
    """Rows dealt by the hash of their first column, so that a retried task deals them alike."""
    count = partitions or df.sparkSession.conf.get(READER_PARTITIONS, None)
    return df.repartition(int(count), df.columns[0]) if count else df


def local_session(app: str = "orderlens", cores: str = "*", **settings: str) -> SparkSession:
    """A session for tests, the benchmark and single-machine use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", settings.pop("shuffle_partitions", "8"))
        .config("spark.driver.memory", settings.pop("driver_memory", "8g"))
    )
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or the context's own
    checkpoint folder. Only local[...] sessions, as in tests, may make one themselves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    named = named or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="orderlens-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Dataset.checkpoint() and iterative estimators at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def new_work_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/orderlens/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = new_work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a few short columns that are broadcast after they were counted.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, broadcast if its counted rows are few; else a shuffle join is left to
    meet it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
