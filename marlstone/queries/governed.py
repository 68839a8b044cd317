"""Row filters, masks, caps and whole days, through secured views and the decider."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import close_day
from ..plans.decide import decide
from ..plans.policy import Grants, from_mapping, secure, secured_session, unfiltered_dependents
from ..session import read
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
NAMES = ("region", "nation", "customer", "orders", "lineitem", "events")
TENANCY = {
    "nation": "n_regionkey = 3", "customer": "c_nationkey in (select n_nationkey from nation where n_regionkey = 3)",
    "orders": "o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 3))",
}
PII = {"customer": {"c_acctbal": frozenset({"pii"})}}


def session(spark, sf_dir, grants, levels=PII):
    return secured_session(spark, lambda s, n: read(s, sf_dir, n), NAMES, grants, levels)


def ask(spark, sf_dir, sql, grants, levels=PII, **options):
    return decide(session(spark, sf_dir, grants, levels), sql, **options).df


REVENUE = """select n_name, count(*) as n_lines, cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(4,2))) as double) as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name"""


@R.df(REVENUE.replace("group by", "where n_regionkey = 3 group by"))
def revenue_by_nation_governed(spark, sf_dir):
    """The flagship: revenue by nation as a role of one region sees it, ruled on, capped."""
    grants = Grants(frozenset(NAMES) - {"region"}, filters={"nation": "n_regionkey = 3"}, mask=frozenset({"pii"}))
    return ask(spark, sf_dir, REVENUE, grants)


@R.df("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'F'")
def rls_orders(spark, sf_dir):
    return ask(spark, sf_dir, "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'", Grants(frozenset({"orders"}), filters={"orders": "o_totalprice > 100000"}), cap=10**9)


@R.df(f"select c_nationkey, count(*) as n from orders join customer on o_custkey = c_custkey where {TENANCY['orders']} and {TENANCY['customer']} group by 1")
def rls_child_tenancy(spark, sf_dir):
    return ask(spark, sf_dir, "select c_nationkey, count(*) as n from orders join customer on o_custkey = c_custkey group by 1", Grants(frozenset({"orders", "customer"}), filters=TENANCY))


@R.df("select o_orderstatus, count(*) as n from orders where o_orderstatus = 'F' or o_totalprice < 50000 group by 1")
def rls_roles_or(spark, sf_dir):
    roles = {"a": {"tables": ["orders"], "filters": {"orders": "o_orderstatus = 'F'"}}, "b": {"tables": ["ORDERS"], "filters": {"orders": "o_totalprice < 50000"}}}
    return ask(spark, sf_dir, "select o_orderstatus, count(*) as n from orders group by 1", from_mapping(roles, ["a", "b"]))


@R.df("select n_name, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey and c_mktsegment = 'BUILDING' where n_regionkey = 1 group by n_name")
def rls_join_intersection(spark, sf_dir):
    grants = Grants(frozenset({"nation", "customer"}), filters={"nation": "n_regionkey = 1", "customer": "c_mktsegment = 'BUILDING'"})
    return ask(spark, sf_dir, "select n_name, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey group by n_name", grants)


@R.df("select c_custkey, cast(null as double) as balance, c_mktsegment from customer")
def mask_projection(spark, sf_dir):
    return ask(spark, sf_dir, "select c_custkey, c_acctbal as balance, c_mktsegment from customer", Grants(frozenset({"customer"}), mask=frozenset({"pii"})), cap=10**9)


@R.df("select c_custkey, cast(null as double) as c_acctbal from customer where c_acctbal > 0")
def mask_and_filter(spark, sf_dir):
    """A filter may read what the reader may not."""
    return ask(spark, sf_dir, "select c_custkey, c_acctbal from customer", Grants(frozenset({"customer"}), filters={"customer": "c_acctbal > 0"}, mask=frozenset({"pii"})), cap=10**9)


@R.df("select c_custkey, c_acctbal from customer where c_acctbal > 5000")
def cleared_column(spark, sf_dir):
    return ask(spark, sf_dir, "select c_custkey, c_acctbal from customer where c_acctbal > 5000", Grants(frozenset({"customer"}), clearance=frozenset({"pii"})), cap=10**9)


@R.df("select c_custkey, c_nationkey, c_mktsegment from customer")
def denied_columns_dropped(spark, sf_dir):
    levels = {"c_acctbal": frozenset({"pii"}), "c_name": frozenset({"phi"})}
    return secure(read(spark, sf_dir, "customer"), "customer", Grants(frozenset({"customer"})), levels)


@R.df("select 1000 as n")
def row_cap(spark, sf_dir):
    return ask(spark, sf_dir, "select o_orderkey from orders", Grants(frozenset({"orders"}))).agg(F.count(F.lit(1)).alias("n"))


@R.df("select o_orderkey from orders order by o_totalprice desc nulls last, o_orderkey limit 7")
def own_limit_kept(spark, sf_dir):
    return ask(spark, sf_dir, "select o_orderkey from orders order by o_totalprice desc nulls last, o_orderkey limit 7", Grants(frozenset({"orders"})))


@R.df("""select * from (values ('select * from orders', 'SELECT_STAR'), ('select r_name from region', 'UNAUTHORIZED_TABLE'), ('drop table orders', 'NOT_SELECT_ONLY'), ('select c_custkey from customer where c_acctbal > 0', 'MASKED_COLUMN_IN_PREDICATE'),
('select o_orderkey from orders order by o_totalprice limit 3', 'LOGIC_LINT'), ('select count(*) as n from orders', 'APPROVED')) t(statement, ruling)""")
def rulings(spark, sf_dir):
    from ..plans.decide import Refused

    s = session(spark, sf_dir, Grants(frozenset(NAMES) - {"region"}, mask=frozenset({"pii"})))
    out = []
    for sql in ("select * from orders", "select r_name from region", "drop table orders", "select c_custkey from customer where c_acctbal > 0", "select o_orderkey from orders order by o_totalprice limit 3", "select count(*) as n from orders"):
        try:
            decide(s, sql)
            out.append((sql, "APPROVED"))
        except Refused as e:
            out.append((sql, e.code))
    return spark.createDataFrame(out, "statement string, ruling string")


@R.df("select * from (values ('lineitem', 'customer'), ('orders', 'customer')) t(\"table\", ancestor)")
def unfiltered_dependents_listed(spark, sf_dir):
    grants = Grants(frozenset({"lineitem", "orders", "customer", "part"}), filters={"customer": "true"})
    return spark.createDataFrame(unfiltered_dependents(grants, {"lineitem": {"orders", "part"}, "orders": {"customer"}}), "table string, ancestor string")


@R.df("select * from (values ('orders', 'lineitem')) t(\"table\", repeated_by)")
def off_grain_report(spark, sf_dir):
    from ..operators.profile import profile_all
    from ..plans.fanout import facts_from, off_grain
    from ..plans.tree import analyzed

    tables = {t: read(spark, sf_dir, t) for t in ("orders", "lineitem")}
    rows = profile_all({t: df.select([c for c in df.columns if c.endswith("key")]) for t, df in tables.items()}).select("table", "column", "row_count", "distinct_count", "null_count").collect()
    s = session(spark, sf_dir, Grants(frozenset({"orders", "lineitem"})))
    found = off_grain(analyzed(s.spark.sql("select sum(l_quantity) as q from orders join lineitem on o_orderkey = l_orderkey")), facts_from([tuple(r) for r in rows]))
    return spark.createDataFrame(found, "table string, repeated_by string")


D1, D2 = "2024-01-05", "2024-01-20"
FORMS = {
    "le": ("<=", (D1,), f"cast(ts as date) <= date '{D1}'"), "gt": (">", (D1,), f"cast(ts as date) > date '{D1}'"), "lt": ("<", (D1,), f"cast(ts as date) < date '{D1}'"), "ge": (">=", (D1,), f"cast(ts as date) >= date '{D1}'"),
    "eq": ("=", (D1,), f"cast(ts as date) = date '{D1}'"), "ne": ("<>", (D1,), f"cast(ts as date) <> date '{D1}'"), "in": ("in", (D1, D2), f"cast(ts as date) in (date '{D1}', date '{D2}')"),
    "notin": ("not in", (D1, D2), f"cast(ts as date) not in (date '{D1}', date '{D2}')"), "between": ("between", (D1, D2), f"cast(ts as date) between date '{D1}' and date '{D2}'"),
    "notbetween": ("not between", (D1, D2), f"cast(ts as date) not between date '{D1}' and date '{D2}'"), "distinct": ("is distinct from", (D1,), f"cast(ts as date) is distinct from date '{D1}'"),
    "notdistinct": ("is not distinct from", (D1,), f"cast(ts as date) is not distinct from date '{D1}'"),
}


def _day(op, days):
    return lambda spark, sf_dir: read(spark, sf_dir, "events").where(close_day(F.col("ts"), op, *days)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


for _name, (_op, _days, _where) in FORMS.items():
    QUERIES[f"day_bound_{_name}"] = _day(_op, _days)
    ORACLE_SQL[f"day_bound_{_name}"] = f"select event_type, count(*) as n from events where {_where} group by 1"
