"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PARTITIONS = 20_000
_local_roots: dict[str, str] = {}

# Runtime settings the operators rely on. AQE splits skewed join partitions, also where the
# split costs one more exchange; all timestamps are read and compared in UTC. A task sorts its rows
# several times, each time with some hundred bytes a row for a few shuffled ones, so AQE merges
# partitions up to a tenth of its usual size.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "6m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, rows: int, rows_per_partition: int = 150_000) -> None:
    """Raise the number of shuffle partitions so that each starts with a bounded number of rows.

    AQE merges small partitions again but never adds any. Beyond `MOST_PARTITIONS` partitions grow
    instead, since every map task writes a block for each of them.
    """
    wanted = min(rows // rows_per_partition + 1, MOST_PARTITIONS)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


def small(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """`df` with a broadcast hint if it has few rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir`, which every executor can reach.

    A machine-local folder is made only where the setting is missing and Spark runs in one
    process; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="tracewright-")
    return _local_roots[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Lineage ends at the written files, so losing an executor later costs no recomputation, and
    values such as partition numbers stay what they were when written.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
