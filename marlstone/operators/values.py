"""The value index: which columns hold which values, and what a literal might have meant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_key_like, is_sensitive, similarity

MOST_VALUES = 200
NEAREST = 8


def indexed_columns(tables: dict[str, DataFrame], profiles: DataFrame, personal: frozenset[tuple[str, str]] = frozenset(), most: int = MOST_VALUES) -> list[tuple[str, str]]:
    """String columns of few values that are neither keys nor personal."""
    few = {(r["table"], r["column"]) for r in profiles.where((F.col("distinct_count") > 0) & (F.col("distinct_count") <= most)).select("table", "column").collect()}
    return sorted((t, f.name) for t, df in tables.items() for f in df.schema if isinstance(f.dataType, T.StringType) and (t, f.name) in few - personal and not is_key_like(f.name) and not is_sensitive(f.name))


def build_index(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """Rows (table, column, value): every distinct value, not null, of the columns."""
    out = None
    for t, c in columns:
        one = tables[t].where(F.col(f"`{c}`").isNotNull()).select(F.lit(t).alias("table"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")).distinct()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else next(iter(tables.values())).sparkSession.createDataFrame([], "table string, column string, value string")


def absent(index: DataFrame, literals: DataFrame) -> DataFrame:
    """The literals (table, column, value) that their indexed column does not hold; columns not indexed say nothing."""
    known = literals.join(index.select("table", "column").distinct(), ["table", "column"], "left_semi")
    return known.join(index, ["table", "column", "value"], "left_anti")


def nearest(index: DataFrame, literals: DataFrame, k: int = NEAREST) -> DataFrame:
    """Rows (table, column, value, rank, near, score): the ``k`` values of the column most like the literal by trigrams, ties by value."""
    near = index.select("table", "column", F.col("value").alias("near"))
    scored = literals.join(near, ["table", "column"]).withColumn("score", similarity("value", "near"))
    w = Window.partitionBy("table", "column", "value").orderBy(F.desc("score"), "near")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("table", "column", "value", "rank", "near", "score")


def holders(index: DataFrame, value: str) -> DataFrame:
    """Rows (table, column): where a value is held."""
    return index.where(F.col("value") == value).select("table", "column")


def holds(df: DataFrame, column: str, value) -> bool:
    """Asks the table itself, reading no further than the first such row."""
    return not df.where(F.col(f"`{column}`") == F.lit(value)).isEmpty()


def first_values(df: DataFrame, column: str, k: int = NEAREST) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.where(c.isNotNull()).select(c.alias("value")).distinct().orderBy("value").limit(k)
