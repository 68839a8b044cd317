"""Certified metrics and chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charts import Chart, Metric, NotCheckable, check_values, compile_chart, measure
from ..session import read
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
REVENUE = Metric("revenue", "cast(sum(cast(l_extendedprice as decimal(18,2))) as double)", "lineitem", frozenset({"l_returnflag", "l_linestatus"}), time="l_shipdate")
COUNT = Metric("n", "count(*)", "lineitem", frozenset({"l_returnflag", "l_linestatus", "l_shipmode"}), time="l_shipdate")
MONEY = "cast(sum(cast(l_extendedprice as decimal(18,2))) as double)"


@R.df(f"select l_returnflag, {MONEY} as revenue from lineitem where l_quantity > 10 group by 1")
def metric_revenue_by_flag(spark, sf_dir):
    return measure(read(spark, sf_dir, "lineitem"), [REVENUE], ["l_returnflag"], where="l_quantity > 10")


@R.df(f"select cast(date_trunc('quarter', l_shipdate) as timestamp) as l_shipdate, {MONEY} as revenue, count(*) as n from lineitem group by 1")
def metric_revenue_by_quarter(spark, sf_dir):
    return measure(read(spark, sf_dir, "lineitem"), [REVENUE, COUNT], [], grain="quarter")


CHARTS = {
    "bar": (Chart("bar", ["l_returnflag"], [REVENUE]), f"select l_returnflag, {MONEY} as revenue from lineitem group by 1"),
    "line": (Chart("line", [], [COUNT], grain="month"), "select cast(date_trunc('month', l_shipdate) as timestamp) as l_shipdate, count(*) as n from lineitem group by 1"),
    "pie": (Chart("pie", ["l_linestatus"], [COUNT]), "select l_linestatus, count(*) as n from lineitem group by 1"),
    "table": (Chart("table", ["l_returnflag", "l_linestatus"], [REVENUE, COUNT], having="n > 100"), f"select l_returnflag, l_linestatus, {MONEY} as revenue, count(*) as n from lineitem group by 1, 2 having count(*) > 100"),
    "pivot": (Chart("pivot", ["l_returnflag", "l_linestatus"], [COUNT], totals=True), "select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag) as __total_l_returnflag, grouping(l_linestatus) as __total_l_linestatus from lineitem group by cube (l_returnflag, l_linestatus)"),
    "big_number": (Chart("big_number", [], [REVENUE]), f"select {MONEY} as revenue from lineitem"),
    "treemap": (Chart("treemap", ["l_linestatus", "l_returnflag"], [REVENUE]), f"select l_linestatus, l_returnflag, {MONEY} as revenue from lineitem group by 1, 2"),
    "sankey": (Chart("sankey", ["l_returnflag", "l_linestatus"], [COUNT]), "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2"),
    "waterfall": (Chart("waterfall", [], [COUNT], grain="year"), "select cast(date_trunc('year', l_shipdate) as timestamp) as l_shipdate, count(*) as n from lineitem group by 1"),
    "top": (Chart("bar", ["l_suppkey"], [Metric("n", "count(*)", "lineitem", frozenset({"l_suppkey"}))], rank=("n", 5)), "select l_suppkey, n from (select l_suppkey, count(*) as n, rank() over (order by count(*) desc) as r from lineitem group by 1) where r <= 5"),
}


def _chart(chart):
    return lambda spark, sf_dir: compile_chart(read(spark, sf_dir, "lineitem"), chart)


for _name, (_chart_spec, _sql) in CHARTS.items():
    QUERIES[f"chart_{_name}"] = _chart(_chart_spec)
    ORACLE_SQL[f"chart_{_name}"] = _sql


@R.df("select cast(floor(p_retailprice / 100) * 100 as double) as bin, count(*) as n from part group by 1")
def chart_histogram(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy((F.floor(F.col("p_retailprice") / 100) * 100).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@R.df("select o_orderpriority, min(o_totalprice) as low, round(quantile_cont(o_totalprice, 0.25), 1) as q1, round(quantile_cont(o_totalprice, 0.5), 1) as med, round(quantile_cont(o_totalprice, 0.75), 1) as q3, max(o_totalprice) as high from orders group by 1")
def chart_box(spark, sf_dir):
    p = lambda q: F.round(F.percentile("o_totalprice", q), 1)
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("low"), p(0.25).alias("q1"), p(0.5).alias("med"), p(0.75).alias("q3"), F.max("o_totalprice").alias("high"))


@R.df("select * from (values ('same', 'CHECKED'), ('changed', 'MISMATCH'), ('empty', 'EMPTY'), ('percent', 'FORMAT_WRONG'), ('rolling', 'NOT_CHECKED')) t(chart, status)")
def chart_value_check(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    own = compile_chart(line, CHARTS["bar"][0])
    out = [("same", check_values(own, own, ["l_returnflag"])), ("changed", check_values(own.withColumn("revenue", F.col("revenue") + 1), own, ["l_returnflag"])), ("empty", check_values(own.limit(0), own.limit(0), ["l_returnflag"]))]
    out.append(("percent", check_values(own, own, ["l_returnflag"], percents=["revenue"])))
    try:
        compile_chart(line, Chart("line", [], [COUNT], grain="month", post=["rolling"]))
    except NotCheckable:
        out.append(("rolling", "NOT_CHECKED"))
    return spark.createDataFrame(out, "chart string, status string")
