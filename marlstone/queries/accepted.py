"""Statements that must be approved: every statement of the relational catalogue, and longer ones, ruled on by the decider before
they run. A refusal here is a false one."""

from __future__ import annotations

import re

from ..plans.policy import Grants
from ..session import TABLES, read
from . import relational
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
#: Statements that read what isn't a granted table, which the decider refuses on purpose: table functions, inline tables outside
#: set operations, PIVOT.
ON_PURPOSE = {"join_range", "pivot_status", "unpivot_part", "list_lambdas", "ties_limit", "recursive_dates"}


def _ruled(sql: str):
    def run(spark, sf_dir):
        from ..plans.decide import decide
        from ..plans.policy import secured_session

        named = [t for t in TABLES if re.search(rf"\b{t}\b", sql, re.I)]  # each table that is opened costs a job
        secured = secured_session(spark, lambda s, n: read(s, sf_dir, n), named, Grants(frozenset(TABLES)))
        return decide(secured, sql, cap=10**9).df

    return run


for _name, _sql in relational.R.text.items():
    if _name not in ON_PURPOSE:
        QUERIES[f"approved_{_name}"] = _ruled(_sql)
        ORACLE_SQL[f"approved_{_name}"] = relational.ORACLE_SQL[_name]

LONGER = {
    "frequent_buyers": """with spent as (select o_custkey as k, year(o_orderdate) as y, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, count(*) as n from orders group by 1, 2),
best as (select y, max(total) as top from spent group by y)
select spent.y, c_mktsegment, count(*) as buyers from spent join best on spent.y = best.y join customer on k = c_custkey where total > 0.5 * top and n > 1 group by 1, 2""",
    "returns_against_average": """with r as (select l_suppkey as s, count(*) filter (where l_returnflag = 'R') as back, count(*) as n from lineitem group by 1)
select s_name, back, n from r join supplier on s = s_suppkey where back > (select 1.1 * avg(back) from r)""",
    "channels_side_by_side": """select o_orderpriority as p, sum(a) as f_orders, sum(b) as o_orders from (
select o_orderpriority, count(*) as a, 0 as b from orders where o_orderstatus = 'F' group by 1 union all select o_orderpriority, 0, count(*) from orders where o_orderstatus = 'O' group by 1) t group by 1""",
    "rank_in_region": """select r_name, n_name, n_cust, rank() over (partition by r_name order by n_cust desc, n_name) as place from (
select r_name, n_name, count(c_custkey) as n_cust from region join nation on r_regionkey = n_regionkey left join customer on n_nationkey = c_nationkey group by r_name, n_name) t""",
    "totals_by_level": """select coalesce(r_name, 'all') as r, coalesce(n_name, 'all') as n, grouping(r_name) + grouping(n_name) as level, count(*) as c
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""",
    "bought_in_both_years": """select count(*) as n from (select o_custkey from orders where year(o_orderdate) = 1996 intersect select o_custkey from orders where year(o_orderdate) = 1997 except select o_custkey from orders where year(o_orderdate) = 1998) t""",
    "not_exists_and_case": """select c_mktsegment, sum(case when c_acctbal < 0 then 1 else 0 end) as owing, avg(case when c_acctbal >= 0 then c_acctbal end) as mean from customer
where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000) group by c_mktsegment having count(*) > 3""",
    "running_share": """select y, n, cast(sum(n) over (order by y rows unbounded preceding) as double) / sum(n) over () as share from (select year(l_shipdate) as y, count(*) as n from lineitem group by 1) t""",
    "quarter_on_quarter": """with q as (select year(o_orderdate) as y, quarter(o_orderdate) as q, count(*) as n from orders group by 1, 2)
select a.y, a.q, a.n, b.n as year_before from q a left join q b on a.y = b.y + 1 and a.q = b.q""",
    "correlated_dear_parts": """select p_brand, count(*) as n from part where p_retailprice > (select avg(x.p_retailprice) from part x where x.p_brand = part.p_brand) group by p_brand""",
    "sizes_in_bands": """select case when p_size between 1 and 10 then 'small' when p_size between 11 and 30 then 'middle' else 'large' end as band, count(distinct p_brand) as brands, min(p_retailprice) as low, max(p_retailprice) as high from part group by 1""",
    "busiest_hours": """select event_type, hour(ts) as h, count(*) as n, count(distinct user_id) as users from events group by 1, 2 having count(*) > 2 order by n desc nulls last, event_type, h limit 40""",
    "first_and_last": """select distinct o_custkey, first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as a, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as z from orders""",
    "two_facts_one_grain": """select n_name, coalesce(a.n, 0) as customers, coalesce(b.n, 0) as suppliers from nation left join (select c_nationkey as k, count(*) as n from customer group by 1) a on n_nationkey = a.k left join (select s_nationkey as k, count(*) as n from supplier group by 1) b on n_nationkey = b.k""",
    "values_as_a_branch": """select o_orderpriority as p, count(*) as n from orders group by 1 union all values ('none', 0) union all select cast(null as string), 0""",
    "limit_null_is_no_limit": "select r_regionkey, r_name from region limit null",
    "quoted_names": """select `o_orderstatus` as `the status`, count(*) as `n of it` from `orders` group by `o_orderstatus`""",
}
DUCK = {"quoted_names": LONGER["quoted_names"].replace("`", '"'), "values_as_a_branch": LONGER["values_as_a_branch"].replace("cast(null as string)", "cast(null as varchar)")}
for _name, _sql in LONGER.items():
    QUERIES[f"approved_{_name}"] = _ruled(_sql)
    ORACLE_SQL[f"approved_{_name}"] = DUCK.get(_name, _sql)


# units of time are read as units, not as columns
_UNITS = "select event_type, sum(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)) as hours, max(datediff(DAY, timestamp_ntz'2024-01-01 00:00:00', ts)) as days from events group by event_type"
QUERIES["date_units"] = _ruled(_UNITS)
ORACLE_SQL["date_units"] = "select event_type, cast(sum(date_sub('hour', timestamp '2024-01-01 00:00:00', ts)) as bigint) as hours, max(date_sub('day', timestamp '2024-01-01 00:00:00', ts)) as days from events group by event_type"
