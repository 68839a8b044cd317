"""Plans that Spark runs wrongly, rewritten."""

import duckdb
import pytest

from compare_oracle import rows
from marlstone.plans.rewrite import rewritten
from marlstone.plans.tree import optimized
from marlstone.queries import catalogue

TOP = "select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1"
LIMITED = {
    "lateral": f"select c_custkey, t.o_orderkey from customer, lateral ({TOP}) t",
    "lateral, left": f"select c_custkey, t.o_orderkey from customer left join lateral ({TOP}) t on t.o_orderkey % 2 = 0",
    "offset": f"select c_custkey, t.o_orderkey from customer, lateral ({TOP} offset 1) t",
    "scalar": f"select c_custkey, ({TOP}) as k from customer",
    "in": f"select c_custkey from customer where c_custkey in ({TOP.replace('select o_orderkey', 'select o_orderkey % 1500')})",
    "computed": f"select c_custkey, t.k from customer, lateral ({TOP.replace('select o_orderkey', 'select o_orderkey + 1 as k')}) t order by c_custkey limit 40",
    "grouped": "select c_custkey, t.n from customer, lateral (select count(*) as n from orders where o_custkey = c_custkey group by o_orderstatus order by max(o_totalprice) desc limit 1) t",
}


def unordered(df):
    """Row numbers without an order: which row is first is up to the shuffle."""
    return [n for n in optimized(df).plan_nodes() if n.kind == "Window" and not n.named.get("orderSpec")]


@pytest.fixture(scope="module")
def own(spark, sf_dir):
    s, con = spark.newSession(), duckdb.connect()
    for t in ("customer", "orders"):
        s.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return s, con


@pytest.mark.parametrize("name", ["lateral_top_order_per_customer", "approved_lateral_top_order_per_customer"])
def test_lateral_queries_number_rows_in_their_order(spark, sf_dir, name):
    assert not unordered(catalogue()[0][name](spark, sf_dir))


@pytest.mark.parametrize("name", sorted(LIMITED))
def test_limits_of_subqueries_keep_their_order(own, name):
    s, con = own
    df = s.sql(LIMITED[name])
    assert unordered(df)  # what makes the rewriting necessary
    out = rewritten(df)
    assert not unordered(out) and out.schema == df.schema
    cur = con.execute(LIMITED[name])
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_other_statements_stay_as_they_are(own):
    df = own[0].sql("select c_custkey from customer order by c_acctbal limit 3")
    assert rewritten(df) is df
