"""Certified overlay, definitions, concepts, repeated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import semantic, values
from ..session import read
from ..sources import catalog
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


@R.df("""select * from (values ('customer', 'c_acctbal', 'Balance in dollars', 'phi,pii'), ('customer', 'c_custkey', 'found', ''), ('customer', 'c_mktsegment', 'found', ''), ('customer', 'c_name', 'found', 'pii'), ('customer', 'c_nationkey', 'found', '')) t("table", "column", description, levels)""")
def certified_overlay(spark, sf_dir):
    found = catalog.introspect({"customer": read(spark, sf_dir, "customer")}).select("table", "column", F.lit("found").alias("description"), F.when(F.col("column").isin("c_name", "c_acctbal"), F.array(F.lit("pii"))).alias("levels"))
    certified = spark.createDataFrame([("customer", "c_acctbal", "Balance in dollars", ["phi"]), ("customer", "gone", "x", [])], "table string, column string, description string, levels array<string>")
    return semantic.overlay(found, certified).withColumn("levels", F.array_join("levels", ","))


@R.df("select 'closed' as term, 'orders' as \"table\", 'o_orderstatus' as \"column\", 'X,C' as codes")
def stale_definition_codes(spark, sf_dir):
    index = values.build_index({"orders": read(spark, sf_dir, "orders")}, [("orders", "o_orderstatus")])
    rows = [("closed", "orders", "o_orderstatus", "status 'X' or 'C'"), ("done", "orders", "o_orderstatus", "status 'F' or 'Z'"), ("plain", "orders", "o_orderstatus", "no code"), ("other", "orders", "o_orderpriority", "'1'")]
    return semantic.stale_codes(spark.createDataFrame(rows, "term string, table string, column string, text string"), index).withColumn("codes", F.array_join("codes", ","))


@R.df("select * from (values ('net revenue'), ('open order')) t(term)")
def definition_selection(spark, sf_dir):
    rows = [("net revenue", True, []), ("open order", False, ["orders"]), ("margin", True, []), ("salary band", False, ["staff"]), ("churn", False, ["orders", "staff"])]
    d = spark.createDataFrame(rows, "term string, public boolean, tables array<string>")
    return semantic.definitions_for(d, ["orders", "nation"], ["orders"], "What was the NetRevenue by nation?").select("term")


GRAMS = "list_distinct([substring('  ' || lower({c}) || ' ', i, 3) for i in range(1, length({c}) + 2)])"


@R.df(f"""with n as (select n_nationkey, n_name, {GRAMS.format(c='n_name')} as t from nation), q as (select {GRAMS.format(c='m')} as t from (select min(n_name) as m from nation)), s as (select n_nationkey, n_name, len(list_intersect(n.t, q.t)) / len(list_distinct(list_concat(n.t, q.t))) as score from n, q)
select 'c_nationkey' as "column", cast(n_nationkey as varchar) as notation, n_name as label, score from s where score >= 0.25 order by score desc, notation limit 15""")
def concept_resolution(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    concepts = nation.select(F.lit("nations").alias("scheme_id"), F.col("n_nationkey").cast("string").alias("notation"), F.col("n_name").alias("label"))
    bound = spark.createDataFrame([("c_nationkey", "nations")], "column string, scheme_id string")
    return semantic.resolve_concepts(concepts, bound, nation.agg(F.min("n_name")).first()[0])


@R.df("""with r as (select user_id as case_id, event_type as outcome, count(*) as n from events group by 1, 2), s as (select *, sum(n) over (partition by case_id) as runs, row_number() over (partition by case_id order by n desc, outcome) as k from r)
select case_id, cast(runs as bigint) as runs, outcome, n / runs as share from s where k = 1""")
def run_stability(spark, sf_dir):
    return semantic.run_stability(read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("run"), F.col("event_type").alias("outcome")))


@R.df("select o_custkey as case_id, max(o_orderkey) as attempt, max_by(o_orderstatus, o_orderkey) as outcome from orders group by 1")
def last_attempts(spark, sf_dir):
    return semantic.last_attempts(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("outcome")))


@R.df("select * from (values ('sum(l_tax)', 'taxes'), ('SUM( l_tax )', 'taxes'), ('avg(l_tax)', 'none')) t(expr, saved)")
def saved_metric_reuse(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    saved = [("a_tax", "sum(l_tax)", False), ("taxes", "sum(l_tax)", True)]
    return spark.createDataFrame([(e, semantic.reuse(line, e, saved) or "none") for e in ("sum(l_tax)", "SUM( l_tax )", "avg(l_tax)")], "expr string, saved string")
