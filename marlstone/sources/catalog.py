"""What tables there are: introspection, differences, scoping, sizes, snapshots, merged sources."""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "table string, column string, type string, ordinal long"


class TablesNotFound(LookupError):
    """A scope's entry matched nothing."""


def introspect(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (table, column, type, ordinal), from schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString(), i) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, COLUMNS)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (table, change): added, dropped, changed or unchanged, by the set of column names."""
    names = lambda df, c: df.groupBy("table").agg(F.sort_array(F.collect_set("column")).alias(c))
    both = names(before, "b").join(names(after, "a"), "table", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "dropped").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return both.select("table", change.alias("change"))


def tables_at(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables in a folder of any file system: files or folders called <name>.parquet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in found]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet") and not n.startswith(("_", ".")))


def scoped(names: list[str], patterns: list[str]) -> list[str]:
    """The tables that the patterns (names or globs, whatever their case) select; each pattern must select one."""
    out: set[str] = set()
    for p in patterns:
        hit = {n for n in names if fnmatch.fnmatchcase(n.lower(), p.lower())}
        if not hit:
            raise TablesNotFound(p)
        out |= hit
    return sorted(out)


def federated(sources: Mapping[str, Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables of several sources in one namespace, as source.table; joins between them are ordinary joins."""
    for name in sources:
        if not name.isidentifier():
            raise ValueError(f"source name {name!r}")
    return {f"{s}.{t}": df for s, tables in sorted(sources.items()) for t, df in sorted(tables.items())}


def register_federated(tables: Mapping[str, DataFrame]) -> None:
    """Views named source__table, since temporary views have one part."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name.replace(".", "__"))


def table_size(df: DataFrame) -> int:
    """Rows, from file footers."""
    return df.select().count()


def functions(spark: SparkSession) -> DataFrame:
    """Rows (function, kind): system and user functions."""
    system = spark.sql("show system functions").select("function", F.lit("system").alias("kind"))
    return system.unionByName(spark.sql("show user functions").select("function", F.lit("user").alias("kind")))


# snapshots: metadata tables under a directory, by version


def content_version(parts: Mapping[str, list]) -> str:
    """A hash of what a snapshot says, whatever the order of its rows."""
    whole = {k: sorted(json.dumps(r, sort_keys=True, default=str) for r in rows) for k, rows in sorted(parts.items())}
    return hashlib.sha256(json.dumps(whole).encode()).hexdigest()[:16]


def save_snapshot(parts: Mapping[str, DataFrame], path: str, version: str) -> None:
    for name, df in parts.items():
        df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: list[str], version: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").where(F.col("version") == version).drop("version") for n in names}


def merge_snapshots(snapshots: Mapping[str, Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Snapshots of several sources as one, tables named source.table; relationships stay with their source."""
    out: dict[str, DataFrame] = {}
    for source, parts in sorted(snapshots.items()):
        for name, df in parts.items():
            if name == "relationships":
                continue
            one = df.withColumn("table", F.concat_ws(".", F.lit(source), "table")) if "table" in df.columns else df
            out[name] = one if name not in out else out[name].unionByName(one)
    return out


class ResultCache:
    """Results by plan, grants and version, least recently used out first beyond a budget of bytes. Only bounded results
    belong here: each is held whole."""

    def __init__(self, budget: int):
        from collections import OrderedDict

        self.budget, self.used, self.kept = budget, 0, OrderedDict()

    def get(self, key: tuple, make: Callable[[], DataFrame]):
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        table = make().toArrow()
        if table.nbytes <= self.budget:
            self.kept[key] = table
            self.used += table.nbytes
            while self.used > self.budget:
                self.used -= self.kept.popitem(last=False)[1].nbytes
        return table
