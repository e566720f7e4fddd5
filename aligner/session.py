"""Session settings and staged tables.

``stage`` is the one place where the library materialises an intermediate result: it writes parquet
under the shared folder the cluster names in ``spark.checkpoint.dir`` and reads it back, so lineage is
cut in a way that survives executor loss and Spark knows the true size of the table afterwards.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "aligner") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(_CHECKPOINT_KEY, tempfile.mkdtemp(prefix="aligner-", dir="/tmp"))
        .getOrCreate()
    )


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Without one, a session within one machine gets a temp folder; a cluster is refused, since its
    executors would each write to a disk of their own."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not _one_machine(spark.sparkContext.master):
        raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="aligner-", dir="/tmp")
    return _own_dirs[app]


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; never one that is being read."""
    return os.path.join(shared_dir(spark), "aligner", f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return written(df, new_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a new folder and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*staged: DataFrame) -> None:
    """Remove the written tables behind staged DataFrames that are no longer needed; other files are left alone."""
    for df in staged:
        spark = df.sparkSession
        as_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        own = as_path(os.path.join(shared_dir(spark), "aligner")).toUri().getPath()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = as_path(folder)
            if path.getParent().toUri().getPath() == own:
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
