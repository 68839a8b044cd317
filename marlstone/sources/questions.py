"""Question sets and their gold results; table definitions written for another system."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_csv


def gold_results(spark: SparkSession, folder: str, case: str) -> dict[str, DataFrame]:
    """The gold results of a case by file name: ``case.csv`` and every alternative ``case_*.csv``. Only names are listed."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"{case}*.csv").load(folder).select("path")
    named = {r["path"].rsplit("/", 1)[-1]: r["path"] for r in listed.collect()}  # a handful of files
    return {n: read_csv(spark, path) for n, path in sorted(named.items()) if re.fullmatch(rf"{re.escape(case)}(_.*)?\.csv", n)}


def load_questions(spark: SparkSession, path: str, question: str = "question", sql: str = "sql", source: str = "db_id") -> DataFrame:
    """Rows (case_id, question, gold_sql, source) of a question set in Parquet; cases are numbered by question and statement,
    which makes the numbers the same wherever rows lie. Rows without a question are left out."""
    raw = spark.read.parquet(path)
    rows = raw.select(F.trim(question).alias("question"), F.col(sql).alias("gold_sql"), (F.col(source) if source in raw.columns else F.lit(None).cast("string")).alias("source")).where("question <> ''")
    return rows.select(F.substring(F.sha2(F.concat_ws("\x00", "question", "gold_sql"), 256), 1, 12).alias("case_id"), "question", "gold_sql", "source")


#: Types of T-SQL and what they are here (fixed values).
TYPES = {
    "bigint": "bigint", "int": "int", "integer": "int", "smallint": "smallint", "tinyint": "smallint", "bit": "boolean", "float": "double", "real": "float",
    "money": "decimal(19,4)", "smallmoney": "decimal(10,4)", "date": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "smalldatetime": "timestamp_ntz",
    "datetimeoffset": "timestamp", "uniqueidentifier": "string", "text": "string", "ntext": "string", "varbinary": "binary", "binary": "binary", "image": "binary",
    "char": "string", "nchar": "string", "varchar": "string", "nvarchar": "string", "time": "string", "xml": "string",
}


def columns_of_ddl(ddl: str) -> dict[str, list[tuple[str, str]]]:
    """Table -> columns (name, type of Spark) of CREATE TABLE statements in T-SQL. Constraints and keys are left out; an unknown
    type is refused."""
    out: dict[str, list[tuple[str, str]]] = {}
    for table, body in re.findall(r"create\s+table\s+([\w.\[\]\" ]+?)\s*\((.*?)\)\s*(?:;|\bgo\b|on\s+\[|$)", re.sub(r"--[^\n]*", "", ddl), re.I | re.S):
        name = re.sub(r"[\[\]\"]", "", table).split(".")[-1].strip()
        columns = []
        for item in re.split(r",(?![^(]*\))", body):
            m = re.match(r"\s*(?:\[([^\]]+)\]|\"([^\"]+)\"|(\w+))\s+\[?(\w+)\]?\s*(\([^)]*\))?", item)
            if not m or (m[3] or "").lower() in ("constraint", "primary", "foreign", "unique", "check", "index"):
                continue
            kind, size = m[4].lower(), m[5]
            if kind in ("decimal", "numeric"):
                columns.append((m[1] or m[2] or m[3], f"decimal{(size or '(18,0)').replace(' ', '')}"))
            elif kind in TYPES:
                columns.append((m[1] or m[2] or m[3], TYPES[kind]))
            else:
                raise ValueError(f"type {kind}")
        out[name] = columns
    return out
