"""Answers checked before they are given, shown, ranked and read from charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, display, retrieve, verify
from ..session import read
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


STATED = "select count(*) from orders where o_orderpriority = '1-URGENT' and year(o_orderdate) = 1996"


@R.df("""select o_orderkey, list_filter([lower(o_orderpriority), cast(year(o_orderdate) as varchar)], lambda x: x not in ('1-urgent', '1996')) as missing from orders""")
def unsaid_literals(spark, sf_dir):
    question = F.concat(F.lit("Orders of "), F.year("o_orderdate"), F.lit(" that are '"), "o_orderpriority", F.lit("'?"))
    return read(spark, sf_dir, "orders").select("o_orderkey", verify.unsaid(question, F.lit(STATED)).alias("missing"))


@R.df("""select 'fine' as answer, true as passed, 'judge' as stage union all select 'nothing', false, case when (select count(*) from orders where o_totalprice < 0) = 0 then 'sanity' end
union all select 'another year', false, 'grounding' union all select 'objection', false, 'judge'""")
def verifier_cascade(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    asked: list = []

    def judge(question, sql, df):
        asked.append(question)
        return "wrong" not in question, "the judge objects"

    some = o.where("year(o_orderdate) = 1996").agg(F.count(F.lit(1)).alias("n"))
    tried = {
        "fine": (some, "How many in 1996?", "select count(*) from orders where year(o_orderdate) = 1996"), "nothing": (o.where("o_totalprice < 0").select("o_orderkey"), "Which are negative?", "select o_orderkey from orders where o_totalprice < 0"),
        "another year": (some, "How many in 1997?", "select count(*) from orders where year(o_orderdate) = 1996"), "objection": (some, "Is this wrong?", "select count(*) from orders"),
    }
    rows = [(name, v.passed, v.stage) for name, (df, q, sql) in tried.items() for v in [verify.verify(df, q, sql, judge)]]
    assert len(asked) == 2  # later stages aren't asked once one has objected
    return spark.createDataFrame(rows, "answer string, passed boolean, stage string")


@R.df("""with g as (select o_orderstatus as s, avg(o_totalprice) as x from orders group by 1), w as (select bool_and(abs(x - round(x, 1)) <= 0.01 * abs(x)) as near, bool_and(abs(x - x * 2) <= 0.01 * abs(x)) as far from g)
select 'same' as result, 'CORRECT' as outcome union all select 'rounded', case when near then 'CORRECT' else 'CORRECT_FACTS' end from w union all select 'more columns', 'CORRECT_FACTS' union all select 'doubled', case when far then 'CORRECT' else 'WRONG' end from w
union all select 'withheld', 'DEFERRED_WRONGLY' union all select 'rightly withheld', 'DEFERRED_CORRECTLY' union all select 'made up', 'WRONG'""")
def case_outcomes(spark, sf_dir):
    gold = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("x"))
    tried = {
        "same": (True, gold), "rounded": (True, gold.withColumn("x", F.round("x", 1))), "more columns": (True, gold.select("x", F.lit("y").alias("note"), "o_orderstatus")), "doubled": (True, gold.withColumn("x", F.col("x") * 2)),
        "withheld": (True, None), "rightly withheld": (False, None), "made up": (False, gold),
    }
    return spark.createDataFrame([(n, verify.outcome(a, got, gold)) for n, (a, got) in tried.items()], "result string, outcome string")


@R.df("""select c_custkey, format('{:,.2f}', cast(c_acctbal as decimal(18,2))) as fixed, replace('$' || format('{:,.0f}', round(cast(abs(c_acctbal) as decimal(28,10)), 0)), '$-', '-$') as dollars,
format('{:.1f}', round(cast(c_acctbal as decimal(28,10)) * 100, 1)) || '%' as share from customer where c_acctbal is not null""")
def shown_numbers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", display.shown("c_acctbal", ",.2f").alias("fixed"), display.shown(F.abs("c_acctbal"), "$,d").alias("dollars"), display.shown("c_acctbal", ".1%").alias("share"))


@R.df("select o_orderkey, left(o_orderpriority, 4) || case when length(o_orderpriority) > 4 then '…' else '' end as priority, 'only the first 15 rows; 5 columns left out; cells cut at 4 characters' as note from (select * from orders order by o_orderkey limit 15)")
def result_page(spark, sf_dir):
    o = read(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").cast("int"), "o_orderpriority", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.lit(1).alias("one"))
    names, rows, note = display.page(o, rows=15, cell=4, columns=2)
    assert names == ["o_orderkey", "o_orderpriority"]
    # keys of more than four digits are cut too: read them from the table's order
    keys = [r[0] for r in o.limit(15).collect()]
    return spark.createDataFrame([(k, r[1], note) for k, r in zip(keys, rows)], "o_orderkey long, priority string, note string")


VECTORS = "list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), (select list_transform(embedding, lambda x: cast(x as double)) from embeddings where vec_id = 3))"


def _three(spark, sf_dir):
    return [float(x) for x in read(spark, sf_dir, "embeddings").where("vec_id = 3").first()["embedding"]]


@R.df(f"select 'q' || vec_id as question, round({VECTORS}, 6) as score from embeddings where vec_id % 3 = 0 and vec_id % 5 <> 0 order by {VECTORS} desc, 'q' || vec_id limit 6")
def examples_ranked(spark, sf_dir):
    """Only examples of granted tables and open columns are scored."""
    v = read(spark, sf_dir, "embeddings")
    tables = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("orders"))).otherwise(F.array(F.lit("orders"), F.lit("payroll")))
    columns = F.when(F.col("vec_id") % 5 == 0, F.array(F.lit("orders.secret"))).otherwise(F.array(F.lit("orders.o_orderkey")))
    examples = v.select(F.concat(F.lit("q"), "vec_id").alias("question"), tables.alias("tables"), columns.alias("columns"), "embedding")
    found = retrieve.examples_like(examples, _three(spark, sf_dir), ["orders"], ["orders.o_orderkey"], 6)
    return found.select("question", F.round("score", 6).alias("score"))


@R.df(f"select 't' || vec_id as term, round({VECTORS}, 6) as score from embeddings where {VECTORS} >= 0.25 order by {VECTORS} desc, 't' || vec_id limit 8")
def definitions_nearest(spark, sf_dir):
    d = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("t"), "vec_id").alias("term"), F.lit("x").alias("text"), "embedding")
    return retrieve.definitions_like(d, _three(spark, sf_dir), 0.25, 8).select("term", F.round("score", 6).alias("score"))


@R.df("""select column_name as name from (describe select * from orders) where column_name not in ('o_totalprice')""")
def selectable_dimensions(spark, sf_dir):
    rows = [(c, t, [f"{t}.{c}"]) for t in ("orders", "customer", "nation") for c in read(spark, sf_dir, t).columns]
    metrics = spark.createDataFrame(rows, "name string, source string, columns array<string>")
    return retrieve.selectable(metrics, ["orders", "nation"], ["orders", "customer"], ["orders.o_totalprice"]).select("name")


@R.df("""select 'What is ' || replace(m.column_name, '_', ' ') || ' by ' || replace(d.column_name, '_', ' ') || '?' as question from (describe select * from orders) m, (describe select * from orders) d
where m.column_type = 'DOUBLE' and d.column_type = 'VARCHAR' order by m.column_name, d.column_name limit 5""")
def starter_questions(spark, sf_dir):
    fields = read(spark, sf_dir, "orders").schema
    of = lambda kind: spark.createDataFrame([(f.name, "orders") for f in fields if f.dataType.typeName() == kind], "name string, source string")
    return retrieve.starters(of("double"), of("string"), 5).select("question")


FORM = {
    "viz_type": "table", "groupby": ["o_orderpriority"], "metrics": [{"expressionType": "SIMPLE", "aggregate": "COUNT_DISTINCT", "column": "o_custkey", "label": "buyers"}, {"expressionType": "SQL", "sqlExpression": "max(o_totalprice)", "label": "top"}],
    "adhoc_filters": [{"clause": "WHERE", "expressionType": "SIMPLE", "subject": "o_orderstatus", "operator": "IN", "comparator": ["F", "O"]}, {"clause": "WHERE", "expressionType": "SIMPLE", "subject": "o_totalprice", "operator": ">=", "comparator": 1000}, {"clause": "HAVING", "expressionType": "SQL", "sqlExpression": "count(*) > 1"}],
    "time_grain_sqla": "P1Y",
}


@R.df("select o_orderpriority, date_trunc('year', o_orderdate) as o_orderdate, count(distinct o_custkey) as buyers, max(o_totalprice) as top from orders where o_orderstatus in ('F', 'O') and o_totalprice >= 1000 group by 1, 2 having count(*) > 1")
def chart_form(spark, sf_dir):
    chart = charts.read_form({**FORM, "adhoc_filters": FORM["adhoc_filters"][:2]}, "orders", "o_orderdate")
    o = read(spark, sf_dir, "orders")
    more = charts.read_form({**FORM, "metrics": [*FORM["metrics"], "count"]}, "orders", "o_orderdate")
    assert more.having == "(count(*) > 1)"
    out = charts.compile_chart(o, charts.read_form({**FORM, "metrics": [*FORM["metrics"], "count"], "adhoc_filters": FORM["adhoc_filters"][:2]}, "orders", "o_orderdate"))
    return out.where("count > 1").select("o_orderpriority", "o_orderdate", *(m.name for m in chart.metrics))


@R.df("select * from (values ('rolling', 'computed after the query: rolling_type'), ('no metric', 'no metric'), ('grain', 'grain ''PT5M''')) t(form, reason)")
def chart_forms_not_checkable(spark, sf_dir):
    out = []
    for name, form in (("rolling", {**FORM, "rolling_type": "mean"}), ("no metric", {**FORM, "metrics": []}), ("grain", {**FORM, "time_grain_sqla": "PT5M"})):
        try:
            charts.read_form(form, "orders")
        except charts.NotCheckable as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "form string, reason string")


@R.df("""select 'o_orderstatus' as "column", 'F' as value, count(*) filter (where o_orderstatus = 'F') > 0 as held from orders union all select 'o_orderstatus', 'X', count(*) filter (where o_orderstatus = 'X') > 0 from orders
union all select 'o_custkey', '1', count(*) filter (where o_custkey = 1) > 0 from orders union all select 'o_orderpriority', null, count(*) filter (where o_orderpriority is null) > 0 from orders""")
def filter_literal_probes(spark, sf_dir):
    return charts.literal_probes(read(spark, sf_dir, "orders"), [("o_orderstatus", "F"), ("o_orderstatus", "X"), ("o_custkey", 1), ("o_orderpriority", None)])
