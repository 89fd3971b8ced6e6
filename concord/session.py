"""Session helpers shared by every module: table loading and durable cuts of lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Written(threading.local):
    """Paths that ``written`` has made in a thread, the newest last: two pipelines in two threads have two lists."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a fixture directory through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: spark.checkpoint.dir, or the one the context has.

    Where neither is set a session on one machine takes a temporary folder; on a cluster that folder would be
    the driver's own, so it is an error there.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="concord-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, read again, and its path for ``remove``; for wide tables, which later steps read in part."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return df.sparkSession.read.parquet(path), path


@contextmanager
def scratch(spark: SparkSession):
    """Removes what ``written`` has written inside, when its readers are done."""
    before = len(_WRITTEN.paths)
    try:
        yield
    finally:
        while len(_WRITTEN.paths) > before:
            remove(spark, _WRITTEN.paths.pop())


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a path through the cluster's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Spark removes the copy when nothing refers to it any more if the context was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; else it stays until the folder is cleared.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table up to this size may be dealt out again before costly expressions.
SMALL_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is small and lies in fewer files than there are cores.

    Such a table has few row groups, so each costly expression would run on as few cores. Large tables have
    files enough and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES or not 0 < len(df.inputFiles()) < cores:
        return df
    plain = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    # by a hash of the row: dealing rows round would sort them first
    return df.repartition(cores, F.xxhash64(*plain)) if plain else df
