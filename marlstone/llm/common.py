"""What the operators of this subpackage share: tables, the shared folder, cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = 1024


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder, else, in a
    local session only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs only what follows. The folder is
    deleted when the driver ends, if ``drop_written`` has not done so before."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    delete_at_end(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, at most ``rows`` rows at a time go to a Python worker: whole texts are wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Give a Python worker's free memory back to the system, where the C library can: workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    _files(spark, path, "deleteOnExit")


def drop_written(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing reads any more."""
    for df in tables:
        _files(df.sparkSession, df._written_to, "delete", True)


def _files(spark: SparkSession, path: str, call: str, *args) -> None:
    """Hadoop's ``FileSystem.call(path, *args)``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(p.getFileSystem(spark._jsc.hadoopConfiguration()), call)(p, *args)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files of queries that are over. It does so when the driver's collector finds
    their plans gone, which may take half an hour in a driver with little to do; a chain of large steps can't wait for that.
    Plans that Python holds are let go with the second call only."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def release_executors(spark: SparkSession) -> None:
    """Have the executors' collectors run, in a session that has executors of its own. A heap that an earlier step has filled
    stays as large as it was for hours, and what Python workers need comes on top of it; a full collection gives back what is free."""
    if spark.sparkContext.master.partition("[")[0] != "local":
        collect_in_tasks(spark)


def collect_in_tasks(spark: SparkSession) -> int:
    """A full collection in each of as many tasks as there are cores; returns their number."""
    n = spark.sparkContext.defaultParallelism
    return len(spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') as done").collect())
