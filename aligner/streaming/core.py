"""Running bounded stream jobs: every job reads what is there now, in micro-batches, and stops.

Results are kept as one folder per batch id, written with overwrite: a batch that is run again after a failure replaces
its own output, so processing is idempotent. Readers combine the folders.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aligner.session import new_path


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Follow the files of an append-only folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, per_batch: Callable[[DataFrame, int], None], checkpoint: str | None = None,
                  output_mode: str = "append", timeout: int | None = None) -> None:
    """Process everything available through ``per_batch`` and stop; an error of the query is raised.

    A backfill takes as long as it needs unless the caller gives a ``timeout`` in seconds.
    """
    checkpoint = checkpoint or new_path(stream.sparkSession, "stream-checkpoint")
    job = (
        stream.writeStream.foreachBatch(per_batch).outputMode(output_mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    if timeout is None:
        job.awaitTermination()
    elif not job.awaitTermination(timeout):
        job.stop()
        raise TimeoutError(f"stream did not finish within {timeout} s")


def batch_path(root: str, batch_id: int) -> str:
    return os.path.join(root, f"batch={batch_id}")


def write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_path(root, batch_id))


def read_batches(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """Rows of all batches with their ``batch`` id; none when no batch has been written yet."""
    try:
        return _batches(spark, root, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))


def _batches(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", root).option("recursiveFileLookup", True).parquet(root).withColumn(
        "batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))


#: Batches after which the last values are folded into a snapshot.
SNAPSHOT_EVERY = 20


class LastValues:
    """The last value per key over all batches so far, as one table per batch and a folded snapshot every few batches.

    A batch reads the newest snapshot before it and the tables since, so its cost doesn't grow with the number of batches. Batch
    ids are consecutive, and a batch that is run again overwrites its own table and snapshot.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], value: str, schema: StructType, every: int = SNAPSHOT_EVERY):
        self.spark, self.root, self.keys, self.value, self.schema, self.every = spark, root, keys, value, schema, every

    def before(self, batch_id: int) -> DataFrame:
        """``(keys, value)`` as of the start of a batch; later batches win."""
        snapshot = batch_id // self.every * self.every - 1
        paths = [batch_path(f"{self.root}/values", i) for i in range(snapshot + 1, batch_id)]
        if snapshot >= 0:
            paths.append(batch_path(f"{self.root}/snapshots", snapshot))
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths).withColumn(
            "_batch", F.when(F.contains(F.col("_metadata.file_path"), F.lit("/snapshots/")), -1).otherwise(
                F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long")))
        return rows.groupBy(*self.keys).agg(F.max_by(self.value, "_batch").alias(self.value))

    def write(self, values: DataFrame, batch_id: int) -> None:
        write_batch(values.select(*self.keys, self.value), f"{self.root}/values", batch_id)
        if (batch_id + 1) % self.every == 0:
            self._fold(batch_id)

    def _fold(self, batch_id: int) -> None:
        """Snapshot of everything up to and with a batch, from the previous snapshot and the tables since."""
        own = self.spark.read.schema(self.schema).parquet(batch_path(f"{self.root}/values", batch_id))
        earlier = self.before(batch_id).join(own, self.keys, "left_anti")
        write_batch(earlier.unionByName(own), f"{self.root}/snapshots", batch_id)


class Levels:
    """Partial results of batches that are folded into larger ones: ``base`` batches into one folder, ``base`` of these into the next.

    Of n batches a reader opens as many folders as the digits of n to that base add up to, and a row is written again once per level. Which
    folders count follows from the last marked batch alone. Batch ids are consecutive; a batch that is run again overwrites its own folders
    and the folds that end with it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, fold: Callable[[DataFrame], DataFrame], base: int = 8):
        self.spark, self.root, self.schema, self.fold, self.base = spark, root, schema, fold, base

    def write(self, df: DataFrame, batch_id: int) -> None:
        write_batch(df, self.root, batch_id)
        size = self.base
        while (batch_id + 1) % size == 0:
            part = size // self.base
            write_batch(self.fold(self._rows([self._path(part, batch_id - i * part) for i in range(self.base)])), self._level(size), batch_id)
            size *= self.base
        system, marks = self._marks()
        system.mkdirs(marks.suffix(f"/{batch_id}"))
        system.delete(marks.suffix(f"/{batch_id - 1}"), True)

    def read(self) -> DataFrame:
        folders = self.folders()
        return self.fold(self._rows(folders)) if folders else self.spark.createDataFrame([], self.schema)

    def folders(self) -> list[str]:
        """The largest folds that together cover all batches up to the last marked one."""
        system, marks = self._marks()
        count = 1 + max((int(s.getPath().getName()) for s in system.listStatus(marks)), default=-1) if system.exists(marks) else 0
        found, at, size = [], 0, 1
        while size * self.base <= count:
            size *= self.base
        while at < count:
            while size > count - at:
                size //= self.base
            at += size
            found.append(self._path(size, at - 1))
        return found

    def _level(self, size: int) -> str:
        return self.root if size == 1 else os.path.join(self.root, "folds", str(size))

    def _path(self, size: int, last: int) -> str:
        return batch_path(self._level(size), last)

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*folders)

    def _marks(self) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, "marks"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path
