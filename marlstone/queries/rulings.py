"""Rulings on generated statements; what is expected follows from the policy's own tables, or from what the data show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import profile_all
from ..plans import fanout, review
from ..plans.decide import Refused, answer, decide
from ..plans.policy import Grants, secured_session
from ..session import read
from .base import Registry
from .governed import session

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


def ruling(secured, sql, **options) -> str:
    try:
        decide(secured, sql, **options)
        return "APPROVED"
    except Refused as e:
        return e.code


SEEN = ("customer", "nation", "orders", "supplier")
ASKED = (*SEEN, "part", "region")
LEVELS = {"customer": {"c_acctbal": frozenset({"pii"}), "c_name": frozenset({"phi"})}, "supplier": {"s_acctbal": frozenset({"pii"}), "s_name": frozenset({"phi"})}}
#: For each column: shown, compared with itself, sorted by, grouped by, read in a subquery, hidden behind a star.
SHAPES = {
    "shown": "select {c} from {t}", "compared": "select count(*) as n from {t} where {c} = {c}", "sorted": "select 1 as one from {t} order by {c} nulls last", "grouped": "select count(*) as n from {t} group by {c}",
    "nested": "select x.v from (select {c} as v from {t}) x where x.v is not null", "star": "select * from {t}", "dropped": "drop table {t}", "renamed": "with x as (select {c} as v from {t}) select v from x",
}
_COLUMNS = " union all ".join(f"select '{t}' as \"table\", column_name as c from (describe select * from {t})" for t in ASKED)
_SHAPES = ", ".join(f"('{s}')" for s in SHAPES)


@R.df(f"""with cols as ({_COLUMNS}), shapes as (select * from (values {_SHAPES}) v(shape))
select "table", c as "column", shape, case when shape = 'dropped' then 'NOT_SELECT_ONLY' when shape = 'star' then 'SELECT_STAR' when "table" not in ('customer', 'nation', 'orders', 'supplier') then 'UNAUTHORIZED_TABLE'
when c like '%_name' and c <> 'n_name' then 'UNAUTHORIZED_COLUMN' when c like '%acctbal' and shape not in ('shown', 'renamed') then 'MASKED_COLUMN_IN_PREDICATE' else 'APPROVED' end as ruling from cols, shapes""")
def ruling_matrix(spark, sf_dir):
    """Every column of six tables in every shape, for a role that sees four of them, one level masked and one denied."""
    secured = secured_session(spark, lambda s, n: read(s, sf_dir, n), ASKED, Grants(frozenset(SEEN), mask=frozenset({"pii"})), LEVELS)
    secured_for = {t: read(spark, sf_dir, t).columns for t in ASKED}
    rows = [(t, c, shape, ruling(secured, sql.format(t=t, c=c))) for t, columns in secured_for.items() for c in columns for shape, sql in SHAPES.items()]
    return spark.createDataFrame(rows, "table string, column string, shape string, ruling string")


EDGES = [("orders", "o_orderkey", "o_totalprice", "lineitem", "l_orderkey", "l_quantity"), ("customer", "c_custkey", "c_acctbal", "orders", "o_custkey", "o_totalprice"), ("part", "p_partkey", "p_retailprice", "lineitem", "l_partkey", "l_tax"), ("supplier", "s_suppkey", "s_acctbal", "lineitem", "l_suppkey", "l_discount")]
FORMS = {
    "plain": "select sum({m}) as s from {a} join {b} on {ka} = {kb}", "comma": "select avg({m}) as s from {a}, {b} where {ka} = {kb}", "cte": "with x as (select {ka} as k, {ma} as v from {a}) select sum({x}) as s from x join {b} on k = {kb}",
    "derived": "select sum({x}) as s from (select {ka} as k, {ma} as v from {a}) x join {b} on k = {kb}", "grouped": "select {kb}, max({m}) as top, sum({m}) as s from {a} left join {b} on {ka} = {kb} group by {kb}",
    "once": "select max({m}) as s, count(distinct {ka}) as n from {a} join {b} on {ka} = {kb}",
}


def _fan(p, pk, pm, c, ck, cm):
    """For each side that is summed, the statements by form."""
    for side in (p, c):
        for form, sql in FORMS.items():
            yield side, form, sql.format(a=p, b=c, ka=pk, kb=ck, ma=pm, m=pm if side == p else cm, x="v" if side == p else cm)


_FORMS = ", ".join(f"('{f}')" for f in FORMS)


@R.df(" union all ".join(f"""select '{p}' as parent, '{c}' as child, side, form, case when form <> 'once' and times > 1 then 'FAN_OUT' else 'APPROVED' end as ruling
from (values ('{p}', (select max(n) from (select count(*) as n from {c} group by {ck}))), ('{c}', (select max(n) from (select count(*) as n from {p} group by {pk})))) s(side, times), (values {_FORMS}) f(form)""" for p, pk, pm, c, ck, cm in EDGES))
def fan_out_rulings(spark, sf_dir):
    """A sum over a join is refused exactly where the other side's key repeats, in whatever form it is written."""
    names = sorted({t for e in EDGES for t in (e[0], e[3])})
    keys_of = {t: sorted({k for e in EDGES for k, x in ((e[1], e[0]), (e[4], e[3])) if x == t}) for t in names}
    rows = profile_all({t: read(spark, sf_dir, t).select(keys_of[t]) for t in names}).select("table", "column", "row_count", "distinct_count", "null_count").collect()
    facts = fanout.facts_from([tuple(r) for r in rows])
    secured = _with(spark, sf_dir, names)
    out = [(e[0], e[3], side, form, ruling(secured, sql, facts=facts)) for e in EDGES for side, form, sql in _fan(*e)]
    return spark.createDataFrame(out, "parent string, child string, side string, form string, ruling string")


def _with(spark, sf_dir, names, **grants):
    return secured_session(spark, lambda s, n: read(s, sf_dir, n), names, Grants(frozenset(names), **grants))


@R.df("""with v as (select distinct o_orderpriority as value, 'held' as kind from orders union all select distinct c_mktsegment, 'of another column' from customer union all select distinct lower(o_orderpriority), 'in lower case' from orders)
select value, kind, case when value in (select o_orderpriority from orders) then 'APPROVED' else 'VALUE_GROUNDING' end as ruling from v""")
def value_rulings(spark, sf_dir):
    """A literal is let through exactly if its column holds it."""
    from ..operators import values as index

    tables = {t: read(spark, sf_dir, t) for t in ("orders", "customer")}
    built = index.build_index(tables, [("orders", "o_orderpriority"), ("customer", "c_mktsegment")])
    known: dict = {}
    for r in built.collect():  # a value index: few values of few columns
        known.setdefault((r["table"], r["column"]), set()).add(r["value"])
    known = {k: frozenset(v) for k, v in known.items()}
    asked = [(v, "held") for v in known["orders", "o_orderpriority"]] + [(v, "of another column") for v in known["customer", "c_mktsegment"]] + [(v.lower(), "in lower case") for v in known["orders", "o_orderpriority"]]
    secured = _with(spark, sf_dir, ["orders"])
    out = [(v, kind, ruling(secured, f"select count(*) as n from orders where o_orderpriority = '{v}'", values=known)) for v, kind in sorted(asked)]
    return spark.createDataFrame(out, "value string, kind string, ruling string")


@R.df("""with t as (select c_mktsegment as m, count(*) as n, sum(case when c_acctbal > 0 then 1 else 0 end) as p from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2) group by 1)
select m, n, p, true as narrowed from t""")
def narrowing_disclosed(spark, sf_dir):
    grants = Grants(frozenset({"customer", "nation"}), filters={"customer": "c_nationkey in (select n_nationkey from nation where n_regionkey = 2)"})
    ruled = decide(session(spark, sf_dir, grants, {}), "select c_mktsegment as m, count(*) as n, sum(case when c_acctbal > 0 then 1 else 0 end) as p from customer group by c_mktsegment")
    return ruled.df.withColumn("narrowed", F.lit(ruled.narrowed == {"customer": {"rows_filtered": True, "masked": []}} and "customer" in ruled.note))


@R.df("select 'cut' as statement, least(1000, count(*)) as n_rows, count(*) >= 1000 as cut from orders union all select 'whole', count(distinct o_orderstatus), false from orders union all select 'own limit', 7, false")
def cap_disclosure(spark, sf_dir):
    secured = session(spark, sf_dir, Grants(frozenset({"orders"})), {})
    asked = {"cut": "select o_orderkey from orders", "whole": "select distinct o_orderstatus from orders", "own limit": "select o_orderkey from orders limit 7"}
    out = []
    for name, sql in asked.items():
        rows, cut = answer(decide(secured, sql))
        out.append((name, len(rows), cut))
    return spark.createDataFrame(out, "statement string, n_rows long, cut boolean")


_READ = {"orders": ("o_custkey", "o_orderkey", "o_orderstatus"), "customer": ("c_custkey", "c_mktsegment"), "lineitem": ("l_orderkey", "l_quantity")}


@R.df(" union all ".join(f"select '{t}' as \"table\", column_name as \"column\", 'complete' as status from (describe select * from {t}) where column_name in ({', '.join(repr(c) for c in cols)})" for t, cols in _READ.items()))
def lineage_of_a_statement(spark, sf_dir):
    sql = """with x as (select l_orderkey as k, sum(l_quantity) as q from lineitem group by 1)
select c_mktsegment, sum(q) as q from orders join x on o_orderkey = k join customer on o_custkey = c_custkey where o_orderstatus = 'F' group by c_mktsegment"""
    found = review.lineage(session(spark, sf_dir, Grants(frozenset({"orders", "customer", "lineitem", "nation"})), {}), sql)
    return spark.createDataFrame([(t, c, found.status) for t, cols in found.tables.items() for c in cols], "table string, column string, status string")


@R.df("""with t as (select * from (values ('orders'), ('nation'), ('ghost'), ('lineitem'), ('region')) v(name)) select name, case when name in ('orders', 'nation') then 'complete' else 'incomplete' end as status,
case when name in (select table_name from information_schema.tables) and name in ('orders', 'nation') then 'proved' else 'rejected' end as proof from t""")
def lineage_and_proof_by_table(spark, sf_dir):
    secured = session(spark, sf_dir, Grants(frozenset({"orders", "nation"})), {})
    out = []
    for name in ("orders", "nation", "ghost", "lineitem", "region"):
        sql = f"select count(*) as n from {name}"
        out.append((name, review.lineage(secured, sql).status, review.proof(lambda sql=sql: secured.spark.sql(sql))))
    return spark.createDataFrame(out, "name string, status string, proof string")


@R.df("select false as timed_out, count(*) as n from orders union all select true, 0")
def decision_deadline(spark, sf_dir):
    secured = session(spark, sf_dir, Grants(frozenset({"orders"})), {})
    sql = "select count(*) as n from orders"
    n = decide(secured, sql, deadline=review.Deadline(600)).df.first()["n"]
    try:
        decide(secured, sql, deadline=review.Deadline(0))
        late = False
    except review.DecisionTimeout:
        late = True
    return spark.createDataFrame([(False, n), (late, 0)], "timed_out boolean, n long")
