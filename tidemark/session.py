"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # UTC keeps epoch arithmetic and calendar columns equal on every host.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Folds over packed arrays are heavy per byte: keep small partitions apart.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A union may take its partitions from its inputs; adaptive execution can undo that after steps above were planned on it.
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Small local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder serves a local session; a cluster without it is refused,
    since each of its machines would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark not in _FOLDERS:
        _FOLDERS[spark] = tempfile.mkdtemp(prefix="tidemark-")
    return _FOLDERS[spark]


#: One temporary folder for each local session.
_FOLDERS: dict[SparkSession, str] = {}


def materialize(df, name: str = "stage"):
    """Write a result to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and keeps column
    pruning for the plans that read it several times.
    """
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
