"""Reading and writing: Parquet, CSV, Arrow, databases by JDBC; queries with a time limit."""

from __future__ import annotations

import threading
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class QueryTimeout(TimeoutError):
    """A query ran longer than it may."""


class QueryCancelled(RuntimeError):
    """A query was cancelled by someone else."""


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header, all text; columns with an empty or repeated name are left out."""
    import csv

    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    first = spark.read.text(path).limit(1).collect()
    names = [c.strip() for c in next(csv.reader([first[0][0].lstrip("\ufeff")]))] if first else []
    keep = [i for i, n in enumerate(names) if n and n not in names[:i]]
    return raw.toDF(*(f"c{i}" for i in range(len(raw.columns)))).select(*(F.col(f"c{i}").alias(names[i]) for i in keep))


def read_jdbc(spark: SparkSession, url: str, query: str, *, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A query of a database, in ``parts`` ranges of ``column`` if given; the driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a SQLite file by Python's own driver, streamed in batches by one task: for small reference data."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        columns = [(r[1], (r[2] or "").upper()) for r in con.execute(f'pragma table_info("{table}")')]
    kinds = {n: "long" if "INT" in k else "double" if any(x in k for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string" for n, k in columns}

    def rows(batches):
        import pandas as pd

        for _ in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                yield from pd.read_sql_query(f'select * from "{table}"', con, chunksize=10_000)

    return spark.range(0, 1, 1, 1).mapInPandas(rows, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def export(tables: dict[str, DataFrame], path: str, max_records: int = 5_000_000) -> None:
    """A folder per table, files of bounded size."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", max_records).parquet(f"{path}/{name}")


def write_one_csv(df: DataFrame, folder: str, name: str) -> None:
    """A bounded result as one CSV file of a given name, written by Spark to a folder beside it and renamed."""
    spark, whole = df.sparkSession, f"{folder}/.{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(whole)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(whole)) if s.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
    fs.delete(path(whole), True)


def append(df: DataFrame, path: str) -> None:
    """The only write that the library offers."""
    df.write.mode("append").parquet(path)


def to_ipc(df: DataFrame) -> bytes:
    """A bounded result as an Arrow stream."""
    import pyarrow as pa

    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()


def bounded(spark: SparkSession, run, seconds: float):
    """``run()`` with its jobs interrupted after ``seconds``: QueryTimeout then, QueryCancelled if others interrupt it."""
    tag, late = f"q-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    sc = spark.sparkContext
    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    timer.start()
    try:
        return run()
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"over {seconds} s") from e
        if "cancel" in str(e).lower():
            raise QueryCancelled(str(e).splitlines()[0]) from e
        raise
    finally:
        timer.cancel()
        sc.setInterruptOnCancel(False)
        sc.removeJobTag(tag)


def fault(e: Exception) -> str:
    """rejected (the statement is at fault), cancelled, or unavailable (the source is)."""
    if isinstance(e, (QueryTimeout, QueryCancelled)):
        return "cancelled"
    text = str(e)
    if isinstance(e, PySparkException) and not any(x in text for x in ("PATH_NOT_FOUND", "Connection refused", "FAILED_READ_FILE", "UnknownHost")):
        return "rejected"
    return "unavailable"
