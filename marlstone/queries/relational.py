"""Joins, aggregations, windows, set operations, limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import GRAINS, grain
from ..operators.keys import asof_join, combine_facts
from ..session import read
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"


def money(c):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


# joins
R.sql("join_inner", f"select n_name, count(*) as n, {MONEY.format('o_totalprice')} as total from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey group by n_name")
R.sql("join_left", "select c_custkey, count(o_orderkey) as n_orders from {customer} left join {orders} on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey")
R.sql("join_right", "select n_name, count(s_suppkey) as n from {supplier} right join {nation} on s_nationkey = n_nationkey group by n_name")
R.sql("join_full", "select a.k as cust, b.k as supp, count(*) as n from (select c_nationkey as k from {customer} where c_acctbal > 5000 group by 1) a full outer join (select s_nationkey as k from {supplier} where s_acctbal > 5000 group by 1) b on a.k = b.k group by 1, 2")
R.sql("join_semi", "select c_custkey, c_name from {customer} left semi join {orders} on c_custkey = o_custkey and o_totalprice > 400000", "select c_custkey, c_name from {customer} where exists (select 1 from {orders} where c_custkey = o_custkey and o_totalprice > 400000)")
R.sql("join_anti", "select c_custkey, c_name from {customer} left anti join {orders} on c_custkey = o_custkey", "select c_custkey, c_name from {customer} where not exists (select 1 from {orders} where c_custkey = o_custkey)")
R.sql("join_cross", "select r_name, s.status from {region} cross join (select distinct o_orderstatus as status from {orders}) s")
R.sql("join_using", "select custkey, n from (select o_custkey as custkey, count(*) as n from {orders} group by 1) a join (select c_custkey as custkey from {customer} where c_acctbal < 0) b using (custkey)")
R.sql("join_natural", "select k, n, m from (select o_custkey as k, count(*) as n from {orders} group by 1) a natural join (select c_custkey as k, c_nationkey as m from {customer}) b")
R.sql("join_range", "select p.band, count(*) as n from {orders} join (values (0, 100000, 'low'), (100000, 300000, 'mid'), (300000, 1000000, 'high')) p(lo, hi, band) on o_totalprice >= p.lo and o_totalprice < p.hi group by p.band")
R.sql("exists_not_exists", "select o_orderpriority, count(*) as n from {orders} where exists (select 1 from {lineitem} where l_orderkey = o_orderkey and l_returnflag = 'R') and not exists (select 1 from {lineitem} where l_orderkey = o_orderkey and l_discount > 0.09) group by 1")
R.sql("correlated_avg", "select l_orderkey, l_linenumber from {lineitem} l where l_quantity > 1.5 * (select avg(l_quantity) from {lineitem} i where i.l_partkey = l.l_partkey)")
R.sql("in_subquery", "select count(*) as n from {orders} where o_custkey in (select c_custkey from {customer} where c_mktsegment in (select max(c_mktsegment) from {customer}))")
R.sql(
    "lateral_top_order_per_customer",
    "select c_custkey, t.o_orderkey from {customer}, lateral (select o_orderkey from {orders} where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) t",
)
R.sql("self_join_pairs", "select a.n_name as a, b.n_name as b from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")


@R.df("""select e.event_id, p.value as right_value, p.event_id as right_event_id from (select * from events where event_type = (select min(event_type) from events)) e
asof left join (select user_id, ts, max_by(value, (event_id, value)) as value, max(event_id) as event_id from events where event_type = (select max(event_type) from events) group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_events(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    tagged = events.crossJoin(F.broadcast(ends))
    left = tagged.where("event_type = lo").select("event_id", "user_id", "ts")
    right = tagged.where("event_type = hi").select("event_id", "user_id", "ts", "value")
    return asof_join(left, right, "ts", ["user_id"], ["event_id", "value"]).select("event_id", "right_value", "right_event_id")


@R.df("""with a as (select o_custkey as k, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1),
b as (select o_custkey as k, count(*) as lines, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from orders join lineitem on o_orderkey = l_orderkey group by 1)
select coalesce(a.k, b.k) as k, n, total, lines, quantity from a full outer join b on a.k is not distinct from b.k""")
def combine_facts_full_outer(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    a = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total"))
    b = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"), money("l_quantity").alias("quantity"))
    return combine_facts(a, b, ["k"])


R.sql("fanout_naive_vs_safe", f"select x.naive, y.safe from (select {MONEY.format('o_totalprice')} as naive from {{orders}} join {{lineitem}} on o_orderkey = l_orderkey) x cross join (select {MONEY.format('o_totalprice')} as safe from {{orders}} where o_orderkey in (select l_orderkey from {{lineitem}})) y")

# aggregations
R.sql("agg_basic", f"select l_returnflag, l_linestatus, count(*) as n, count(l_tax) as n_tax, {MONEY.format('l_extendedprice')} as total, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship, {MONEY.format('l_quantity')} / count(*) as avg_quantity from {{lineitem}} group by 1, 2")
R.sql("agg_filter", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_totalprice > 200000) as n_large, min(o_totalprice) filter (where o_orderstatus = 'O') as low_open from {orders} group by 1")
R.sql("count_distinct", "select c_mktsegment, count(distinct c_nationkey) as nations, count(distinct c_custkey) as customers from {customer} group by 1")
R.sql("having_not_null", "select o_custkey, max(o_totalprice) as top from {orders} group by 1 having (max(o_totalprice) > 300000) is not null and count(*) > 5")
R.sql("group_by_all", "select o_orderstatus, year(o_orderdate) as y, count(*) as n from {orders} group by all")
R.sql("group_by_expression", "select floor(p_size / 10) as band, count(*) as n from {part} group by floor(p_size / 10)", "select cast(floor(p_size / 10) as bigint) as band, count(*) as n from {part} group by 1")
R.sql("listagg_within_group", "select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from {nation} group by 1", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from {nation} group by 1")
R.sql("percentile_within_group", "select o_orderstatus, percentile_cont(0.5) within group (order by o_totalprice) as med from {orders} group by 1")
R.sql("distinct_rows", "select distinct o_orderstatus, o_orderpriority from {orders}")
GROUPED = f"select l_returnflag, l_linestatus, grouping(l_returnflag) as g1, grouping(l_linestatus) as g2, count(*) as n, {MONEY.format('l_quantity')} as quantity from {{lineitem}} group by "
R.sql("rollup_status", GROUPED + "rollup (l_returnflag, l_linestatus)")
R.sql("cube_flags", GROUPED + "cube (l_returnflag, l_linestatus)")
R.sql("grouping_sets", GROUPED + "grouping sets ((l_returnflag), (l_linestatus), ())")


@R.df("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1")
def distinct_on_first_order(spark, sf_dir):
    # min_by aggregates map-side, where a window would sort and shuffle every order
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("f"))
    return first.select("o_custkey", "f.o_orderkey", "f.o_totalprice")


# windows
R.sql("window_running_total", "select o_custkey, o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as double) as running from {orders}")
R.sql("window_lag_delta", "select event_id, value - lag(value) over (partition by user_id order by ts, event_id) as delta, lead(event_id) over (partition by user_id order by ts, event_id) as following from {events}")
R.sql("window_ntile", "select c_custkey, ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey) as quartile from {customer}")
R.sql("window_first_last", "select event_id, first_value(event_type) over w as first_type, last_value(event_type) over w as last_type from {events} window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)")
R.sql(
    "window_range_7d",
    "select event_id, count(*) over (partition by event_type order by ts range between interval '7' day preceding and current row) as n_week from {events}",
)
R.sql("window_rank_counts", "select p_partkey, rank() over (partition by p_brand order by p_size desc) as r, dense_rank() over (partition by p_brand order by p_size desc) as d, count(*) over (partition by p_brand) as n from {part}")
R.sql("window_share", "select n, share, o_orderpriority from (select o_orderpriority, count(*) as n, count(*) / sum(count(*)) over () as share from {orders} group by 1) t")
R.sql("qualify_rewrite", "select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from {orders}) t where rn <= 2", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from {orders} qualify rn <= 2")

# sorts and limits
R.sql("topk_orderpriority", "select o_orderpriority as value, count(*) as n from {orders} where o_orderpriority is not null group by 1 order by n desc, value limit 3")
R.sql("topn_per_group", "select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from {part}) t where rn <= 3")
R.sql("ties_limit", "select o_custkey, n from (select o_custkey, count(*) as n, rank() over (order by count(*) desc) as r from {orders} group by 1) t where r <= 5")
R.sql("percent_share_limit", "select c_custkey from (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as rn, count(*) over () as n from {customer}) t where rn <= ceil(n * 0.05)")
R.sql("nulls_last_topn", "select c_custkey, last_order from (select c_custkey, max(o_orderdate) as last_order from {customer} left join {orders} on c_custkey = o_custkey and o_totalprice > 450000 group by 1) t order by last_order desc nulls last, c_custkey limit 20")

# set operations and CTEs
R.sql("set_union", "select c_nationkey as k from {customer} where c_acctbal > 9000 union select s_nationkey from {supplier}")
R.sql("set_union_all", "select c_nationkey as k from {customer} union all select s_nationkey from {supplier}")
R.sql("set_intersect", "select c_nationkey as k from {customer} where c_acctbal > 9000 intersect select s_nationkey from {supplier}")
R.sql("set_except", "select n_nationkey as k from {nation} except select s_nationkey from {supplier} where s_acctbal > 5000")
R.sql("set_except_all", "select l_linenumber as k from {lineitem} where l_quantity > 25 except all select l_linenumber from {lineitem} where l_quantity <= 25")
R.sql("set_intersect_precedence", "select n_regionkey as k from {nation} union select 9 intersect select 8")
R.sql("cte_chain", "with f as (select o_custkey, count(*) as n from {orders} group by 1), g as (select n, count(*) as customers from f group by 1) select * from g where n > 3")
R.sql("recursive_dates", "with recursive d(day) as (select date '2024-01-01' union all select date_add(day, 1) from d where day < date '2024-02-15') select day from d", "with recursive d(day) as (select date '2024-01-01' union all select cast(day + interval 1 day as date) from d where day < date '2024-02-15') select day from d")


@R.df("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as F, count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'P') as P from orders group by 1")
def pivot_status(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0, ["F", "O", "P"])


@R.df("select p_partkey, 'p_size' as measure, cast(p_size as double) as value from part union all select p_partkey, 'p_retailprice', p_retailprice from part")
def unpivot_part(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return part.unpivot("p_partkey", ["p_size", "p_retailprice"], "measure", "value")


# scalar functions
R.sql("cast_try_cast", "select c_custkey, try_cast(substring(c_name, 10, 20) as bigint) as number, try_cast(c_mktsegment as int) as none, cast(c_acctbal as decimal(12,1)) as bal from {customer}", "select c_custkey, try_cast(substring(c_name, 10, 20) as bigint) as number, try_cast(c_mktsegment as int) as none, cast(c_acctbal as decimal(12,1)) as bal from {customer}")
R.sql("extract_parts", "select o_orderkey, extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, extract(day from o_orderdate) as d from {orders}")
R.sql("date_differences", "select o_orderkey, datediff(l_shipdate, o_orderdate) as days, timestampdiff(HOUR, o_orderdate, l_shipdate) as hours from {orders} join {lineitem} on o_orderkey = l_orderkey and l_shipdate >= o_orderdate", "select o_orderkey, date_diff('day', o_orderdate, l_shipdate) as days, date_diff('hour', o_orderdate, l_shipdate) as hours from {orders} join {lineitem} on o_orderkey = l_orderkey and l_shipdate >= o_orderdate")
R.sql("case_coalesce_nullif", "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as state, coalesce(nullif(o_orderpriority, '1-URGENT'), 'now') as priority from {orders}")
R.sql("json_props_extract", "select event_id, cast(get_json_object(props, '$.k') as bigint) as k, get_json_object(props, '$.none') as none from {events}", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as none from {events}")
R.sql("like_filters", "select p_partkey from {part} where lower(p_name) like '%a%' and p_type not like 'ECONOMY%' and p_brand ilike 'brand#1%' and (p_size > 20) is true and (p_size > 40) is not true")
R.sql("list_lambdas", "select vec_id, size(filter(embedding, x -> x > 0)) as n_positive, size(transform(embedding, x -> x * 2)) as width, element_at(map('a', vec_id), 'a') as m from {embeddings}", "select vec_id, len(list_filter(embedding, lambda x: x > 0)) as n_positive, len(list_transform(embedding, lambda x: x * 2)) as width, map {{'a': vec_id}}['a'] as m from {embeddings}".replace("{{", "MAP_OPEN").replace("}}", "MAP_CLOSE"))
ORACLE_SQL["list_lambdas"] = ORACLE_SQL["list_lambdas"].replace("MAP_OPEN", "{").replace("MAP_CLOSE", "}")


def _grain(unit):
    def run(spark, sf_dir):
        e = read(spark, sf_dir, "events")
        return e.groupBy(grain(unit, "ts").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))

    return run


for _unit in GRAINS:
    QUERIES[f"grain_{_unit}"] = _grain(_unit)
    ORACLE_SQL[f"grain_{_unit}"] = f"select cast(date_trunc('{_unit}', ts) as timestamp) as at, count(*) as n, max(value) as top from events group by 1"


@R.df("select l_orderkey, l_linenumber, quantity_band, n from (select l_orderkey, l_linenumber, case when l_quantity < 10 then 'few' when l_quantity < 30 then 'some' else 'many' end as quantity_band, count(*) over (partition by l_suppkey) as n from lineitem)")
def window_builder(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    band = F.when(F.col("l_quantity") < 10, "few").when(F.col("l_quantity") < 30, "some").otherwise("many")
    return li.select("l_orderkey", "l_linenumber", band.alias("quantity_band"), F.count(F.lit(1)).over(Window.partitionBy("l_suppkey")).alias("n"))
