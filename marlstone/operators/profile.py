"""Profiles of tables: counts, keys, code vocabularies, uniqueness within partitions, functional dependencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_key_like, is_sensitive

MOST_CODES = 25
MOST_PARTITIONS = 8


def groupable(kind: T.DataType) -> bool:
    """Whether values can be grouped: maps and variants can't, anywhere within."""
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return groupable(kind.elementType)
    return all(groupable(f.dataType) for f in kind) if isinstance(kind, T.StructType) else True


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def profile(df: DataFrame, table: str) -> DataFrame:
    """Rows (table, column, type, row_count, distinct_count, null_count, measurement), one per column.

    Each column is read by itself and grouped map-side first, so no row is copied for the sake of several distinct counts. A
    column whose type can't be grouped is UNSUPPORTED, its counts null.
    """
    out = None
    for f in df.schema:
        if groupable(f.dataType):
            values = df.groupBy(_q(f.name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            counts = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("v").alias("distinct_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"))
        else:
            counts = df.sparkSession.range(1).select(*(F.lit(None).cast("long").alias(c) for c in ("row_count", "distinct_count", "null_count")))
        one = counts.select(
            F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), "row_count", "distinct_count", "null_count",
            F.lit("MEASURED" if groupable(f.dataType) else "UNSUPPORTED").alias("measurement"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def profile_all(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [profile(df, name) for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows (value, n): the ``k`` most frequent values that are not null, ties by value."""
    return df.where(_q(column).isNotNull()).groupBy(_q(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def key_facts(profiles: DataFrame) -> DataFrame:
    """Rows (table, column, is_unique): true, false, or null where not measured."""
    return profiles.select("table", "column", (F.col("distinct_count") == F.col("row_count") - F.col("null_count")).alias("is_unique"))


def vocabulary_columns(profiles: DataFrame, declared_keys: tuple[tuple[str, str], ...] = (), most: int = MOST_CODES) -> list[tuple[str, str]]:
    """Columns whose values look like codes: few, repeated, not keys, not personal."""
    few = profiles.where((F.col("distinct_count") > 0) & (F.col("distinct_count") <= most) & (F.col("distinct_count") < F.col("row_count")))
    rows = few.select("table", "column").collect()  # as many as the catalogue has columns at most
    return sorted((r["table"], r["column"]) for r in rows if not is_key_like(r["column"]) and not is_sensitive(r["column"]) and (r["table"], r["column"]) not in declared_keys)


def code_vocabulary(tables: dict[str, DataFrame], profiles: DataFrame, **options) -> DataFrame:
    """Rows (table, column, code, n): the whole vocabulary of every column that looks coded."""
    out = None
    for t, c in vocabulary_columns(profiles, **options):
        one = tables[t].where(_q(c).isNotNull()).groupBy(_q(c).cast("string").alias("code")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), F.lit(c).alias("column"), "code", "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table string, column string, code string, n long")
    return out


def partition_label(value: Column, kind: T.DataType) -> Column:
    """How a filter on one value is spelt: =1, =true, ='Y'."""
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("='"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = value.cast("decimal(38,0)")
        return F.concat(F.lit("="), F.when(value == whole.cast("double"), whole.cast("string")).otherwise(value.cast("string")))
    return F.concat(F.lit("="), value.cast("string"))


def partition_uniqueness(df: DataFrame, table: str, profiles: DataFrame, most: int = MOST_PARTITIONS) -> DataFrame:
    """Rows (table, column, label, n_rows, unique_columns): for columns of at most two values, and for nullable dates where
    they are null, which columns that repeat in the table don't repeat within the partition. Partitions of one row
    name no columns."""
    mine = {r["column"]: r for r in profiles.where(F.col("table") == table).collect()}  # one row per column
    kinds = {f.name: f.dataType for f in df.schema}
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    measured = [c for c in df.columns if mine[c]["measurement"] == "MEASURED"]
    repeating = [c for c in measured if mine[c]["distinct_count"] < mine[c]["row_count"] - mine[c]["null_count"]]
    flags = [c for c in measured if 0 < mine[c]["distinct_count"] <= 2 and not isinstance(kinds[c], dates) and not is_sensitive(c)]
    ends = [c for c in measured if isinstance(kinds[c], dates) and mine[c]["null_count"]]
    out = None
    for part in (flags + ends)[:most]:
        others = [c for c in repeating if c != part]
        if not others:
            continue
        aggs = [F.count(F.lit(1)).alias("n_rows"), *(F.count_distinct(_q(c)).alias(f"d{i}") for i, c in enumerate(others)), *(F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(others))]
        if part in flags:
            groups = df.where(_q(part).isNotNull()).groupBy(_q(part).alias("value")).agg(*aggs).withColumn("label", partition_label(F.col("value"), kinds[part]))
        else:
            groups = df.where(_q(part).isNull()).agg(*aggs).withColumn("label", F.lit("IS NULL"))
        unique = F.array_compact(F.array(*(F.when((F.col("n_rows") >= 2) & (F.col(f"c{i}") > 0) & (F.col(f"d{i}") == F.col(f"c{i}")), F.lit(c)) for i, c in enumerate(others))))
        one = groups.select(F.lit(table).alias("table"), F.lit(part).alias("column"), "label", "n_rows", F.sort_array(unique).alias("unique_columns"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "table string, column string, label string, n_rows long, unique_columns array<string>")


def is_functional(df: DataFrame, code: str, label: str) -> DataFrame:
    """One row (holds): whether each code that is not null has exactly one label. False where no code has any row."""
    per = df.where(_q(code).isNotNull()).groupBy(_q(code).alias("c")).agg(F.count_distinct(_q(label)).alias("labels"))
    return per.agg(F.coalesce(F.bool_and(F.col("labels") == 1), F.lit(False)).alias("holds"))


def functional_dependencies(df: DataFrame, table: str, pairs: list[tuple[str, str]]) -> DataFrame:
    out = None
    for a, b in pairs:
        one = is_functional(df, a, b).select(F.lit(table).alias("table"), F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), "holds")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class TooLarge(Exception):
    """Raised instead of an exact profile of a table beyond the stated size."""

    table: str
    rows: int
    most: int


def refuse_large(df: DataFrame, table: str, most: int) -> int:
    """The table's row count from file footers; ``TooLarge`` beyond ``most``."""
    n = df.select().count()
    if n > most:
        raise TooLarge(table, n, most)
    return n
