"""SparkSession helpers.

The engine never starts servers: the Spark UI is off.  Checkpoints go to the
shared folder named by ``spark.checkpoint.dir``; a local folder is set only when
the session has none (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "outcome_engine",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Settings for a large cluster (hundreds of executors, ~100 TB input): many shuffle
# partitions that AQE coalesces to ~256 MB, skew splitting, 256 MB scan splits.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.ui.enabled": "false",
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a scratch one only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage: the engine stores "
                               "its statistics tables there and a machine-local folder does not survive "
                               "executor loss")
        configured = tempfile.mkdtemp(prefix="oe-ckpt-", dir="/tmp")  # local runs and tests only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_STORED: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table as Parquet to the shared checkpoint folder and read it back.

    It survives executor loss, and later plans prune its columns and push filters
    into its scan.  ``drop_stored`` deletes these tables.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/oe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder; ``drop_stored`` deletes what is written there."""
    path = f"{ensure_checkpoint_dir(spark)}/oe-{label}-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def stored_tables() -> int:
    """How many tables ``cut_lineage`` wrote in this process and still keeps."""
    return len(_STORED)


def drop_stored(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``cut_lineage`` wrote after the first ``since``; call when no result reads them any more."""
    n = len(_STORED) - since
    while len(_STORED) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


BROADCAST_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only behind a size check.

    Meant for stored tables (``cut_lineage``): their size in rows times the width
    of a row, strings at their longest, bounds what is sent.  Returns the
    (possibly hinted) frame and whether it was hinted; beyond ``max_bytes`` the
    caller's join stays a shuffle join.
    """
    width = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.max(F.octet_length(f.name)), F.lit(0)).cast("long")
    size = df.agg((F.count(F.lit(1)) * width).alias("b")).first()["b"] or 0
    return (F.broadcast(df), True) if size <= max_bytes else (df, False)


def per_group(df: DataFrame) -> DataFrame:
    """Store a table of one row per group and broadcast it if its size allows.

    For joining statistics of a few groups back to detail rows: a shuffle join on
    such a key would send all rows to as many tasks as there are groups.
    """
    return sized_broadcast(cut_lineage(df))[0]
