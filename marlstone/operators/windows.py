"""Counts over ranges of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_count(df: DataFrame, by: list[str], on: str, start: Column, name: str) -> DataFrame:
    """Each row with how many rows of its ``by`` have an ``on`` from ``start`` to its own, both included; rows without an
    ``on`` count each other. As ``count(*) over (partition by .. order by .. range between .. preceding and current row)``.

    ``start``: an expression of ``on``, not later than it. ``on``: a timestamp. Spark's window keeps a partition in one task
    and counts each frame anew; here the count is a difference of two running counts: up to ``on``, and before ``start``.
    Equal rows are collapsed first. Running counts are made within hours, and carried from hour to hour by their totals.
    The counts meet their rows by time first, as Spark's sort compares a first column that is a number by itself, a struct
    only field by field.
    """
    keys = [F.col(f"`{c}`") for c in by]
    at = F.col(f"`{on}`")
    key = F.struct(*keys, at)  # a struct is never null and equals one with the same nulls
    time = F.coalesce(at, F.lit("1970-01-01").cast(df.schema[on].dataType))
    points = df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("__n"))
    ends = F.array(F.struct(start.alias("at"), F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), F.struct(at.alias("at"), F.lit(1).alias("end"), F.col("__n").alias("n")))
    marks = points.select(time.alias("__t"), key.alias("__k"), F.struct(*(keys or [F.lit(0)])).alias("__g"), F.explode(ends).alias("__m"))
    marks = marks.select("__t", "__k", "__m", F.struct("__g", F.to_date("__m.at").alias("day"), F.hour("__m.at").alias("hour")).alias("__b"))
    up_to = Window.partitionBy("__b").orderBy("__m.at", "__m.end").rowsBetween(Window.unboundedPreceding, 0)
    within = marks.select("__t", "__k", "__b", F.col("__m.end").alias("__end"), F.sum("__m.n").over(up_to).alias("__within"))
    totals = marks.groupBy("__b").agg(F.sum("__m.n").alias("__total"))
    earlier = Window.partitionBy("__b.__g").orderBy("__b.day", "__b.hour").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("__b").alias("__hour"), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    running = within.join(before, F.col("__b") == F.col("__hour")).select("__t", "__k", "__end", (F.col("__within") + F.col("__before")).alias("__r"))
    counted = running.groupBy("__t", "__k").agg(F.sum(F.when(F.col("__end") == 1, F.col("__r")).otherwise(-F.col("__r"))).alias("__c"))
    return df.join(counted, (time == counted["__t"]) & (key == counted["__k"])).select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce("__c", F.lit(0)).alias(name))
