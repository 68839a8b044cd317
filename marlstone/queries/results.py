"""Comparing results, and statistics of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results, stats
from ..session import read
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


@R.df("""with a as (select l_linenumber as c0, count(*) as n from lineitem where l_quantity > 25 group by 1), b as (select l_linenumber as c0, count(*) as n from lineitem where l_quantity <= 25 group by 1)
select cast(coalesce(a.c0, b.c0) as double) as c0, coalesce(a.n, 0) as left_n, coalesce(b.n, 0) as right_n from a full outer join b using (c0) where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def result_diff_multiset(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    found = results.diff(line.where("l_quantity > 25").select("l_linenumber"), line.where("l_quantity <= 25").select("l_linenumber"))
    return found.select(F.col("c0.number").alias("c0"), "left_n", "right_n")


@R.df("select * from (values (0, 0), (1, 0), (2, 1), (3, 0)) t(result, grp)")
def cluster_agreement(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("x"))
    same = [a, a.select("x", F.col("o_orderstatus").alias("s"), "n"), a.where("n > 1000000"), a.withColumn("x", F.col("x") * 1.0001)]
    groups = results.clusters(same)
    return spark.createDataFrame([(i, g) for g, members in enumerate(groups) for i in members], "result int, grp int")


GRADED = """with g as (select o_orderstatus, o_orderpriority, avg(o_totalprice) as x from orders group by 1, 2), r as (select *, round(x, 2) as rounded, x * 1.004 as shifted, x * 1.5 as wrong from g),
t as (select 'rounded' as result, x, rounded as y from r union all select 'shifted', x, shifted from r union all select 'wrong', x, wrong from r)
select result, bool_and(abs(x - y) <= 0.01 * greatest(abs(x), abs(y))) as agree, bool_and(abs(x - y) <= greatest(5e-7, 1e-5 * abs(x))) as strict, bool_and(abs(x - y) <= greatest(5e-7, 1e-5 * abs(x)) or round(x, 2) = y) as facts from t group by 1"""


@R.df(GRADED)
def graded_readings(spark, sf_dir):
    """Three results of one question over a whole table, read in three ways; columns out of order, and one too many for facts."""
    gold = read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("x"))
    tried = {"rounded": F.round("x", 2), "shifted": F.col("x") * 1.004, "wrong": F.col("x") * 1.5}
    out = []
    for name, value in tried.items():
        got = gold.select(value.alias("y"), "o_orderpriority", "o_orderstatus")
        more = got.withColumn("extra", F.lit("n"))
        facts = results.facts_equal([tuple(r) for r in gold.collect()], [tuple(r) for r in more.collect()])  # as many rows as groups
        out.append((name, results.equal(gold, got), results.equal(gold, got, results.strict), facts))
    return spark.createDataFrame(out, "result string, agree boolean, strict boolean, facts boolean")


@R.df("""with c as (select 'g' || o_orderstatus as name, count(*) filter (where o_totalprice > 100000) % 13 as a, count(*) filter (where o_totalprice <= 100000) % 13 as b from orders group by o_orderstatus),
f as (select i, case when i = 0 then 1.0 else list_product(range(1, i + 1)) end as v from range(0, 30) t(i)),
k as (select name, a, b, sum(x.v / (y.v * z.v)) / pow(2, a + b) as p_better from c join f x on x.i = a + b join f y on y.i >= a and y.i <= a + b join f z on z.i = a + b - y.i group by name, a, b),
m as (select name, a, b, sum(x.v / (y.v * z.v)) / pow(2, a + b) as tail from c join f x on x.i = a + b join f y on y.i >= greatest(a, b) and y.i <= a + b join f z on z.i = a + b - y.i group by name, a, b)
select name, k.a as only_a, k.b as only_b, round(p_better, 9) as p_better, round(least(1, 2 * tail), 9) as p from k join m using (name)""")
def paired_tests(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    high = F.col("o_totalprice") > 100000
    pairs = o.groupBy(F.concat(F.lit("g"), "o_orderstatus").alias("name")).agg((F.count_if(high) % 13).alias("only_a"), (F.count_if(~high) % 13).alias("only_b"))
    return stats.paired_test(pairs).select("name", "only_a", "only_b", F.round("p_better", 9).alias("p_better"), F.round("p", 9).alias("p"))


@R.df("""with t as (select o_orderpriority as name, count(*) filter (where o_orderstatus = 'P') / count(*) as p from orders group by 1), r as (select *, row_number() over (order by p, name) as rank, count(*) over () as m from t)
select name, round(p, 9) as p, rank, round(least(1, max(p * (m - rank + 1)) over (order by p, name rows unbounded preceding)), 9) as adjusted, least(1, max(p * (m - rank + 1)) over (order by p, name rows unbounded preceding)) < 0.1 as passes from r""")
def step_down_correction(spark, sf_dir):
    tests = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.count_if(F.col("o_orderstatus") == "P") / F.count(F.lit(1))).alias("p"))
    return stats.step_down(tests, 0.1).select("name", F.round("p", 9).alias("p"), F.col("rank").cast("long").alias("rank"), F.round("adjusted", 9).alias("adjusted"), "passes")


@R.df("""select 'status' as "column", true as found union all select 'total', true union all select 'other', count(distinct o_orderstatus) = 0 from orders""")
def columns_found_in_result(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    gold = o.select(F.col("o_orderstatus").alias("status"), "total", (F.col("total") * 2).alias("other"))
    return results.columns_found(gold, o.select((F.col("total") + F.lit(0.004)).alias("t"), F.lit(1).alias("one"), "o_orderstatus"))


@R.df("select * from (values ('ok', 'fine'), ('empty', 'no_rows'), ('null', 'all_null')) t(answer, ruling)")
def sanity_rulings(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    tried = [("ok", o.agg(F.max("o_totalprice"))), ("empty", o.where("o_totalprice < 0").select("o_orderkey")), ("null", o.where("o_totalprice < 0").agg(F.sum("o_totalprice")))]
    return spark.createDataFrame([(n, results.sanity(df) or "fine") for n, df in tried], "answer string, ruling string")


CASES = """(select doc_id as case_id, case when doc_id % 7 = 0 then 'WRONG' when doc_id % 7 = 1 then 'CORRECT_FACTS' when doc_id % 7 = 2 then 'DEFERRED_WRONGLY' when doc_id % 7 = 3 then 'DEFERRED_CORRECTLY' when doc_id % 7 = 4 then 'ERROR' else 'CORRECT' end as outcome, doc_id % 5 = 0 as unportable, lang from documents)"""


def _cases(spark, sf_dir):
    m = F.col("doc_id") % 7
    outcome = F.when(m == 0, "WRONG").when(m == 1, "CORRECT_FACTS").when(m == 2, "DEFERRED_WRONGLY").when(m == 3, "DEFERRED_CORRECTLY").when(m == 4, "ERROR").otherwise("CORRECT")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), outcome.alias("outcome"), (F.col("doc_id") % 5 == 0).alias("unportable"), "lang")


@R.df(f"""select lang, count(*) as cases, count(*) filter (where outcome <> 'DEFERRED_CORRECTLY') as answerable, count(*) filter (where outcome in ('CORRECT', 'CORRECT_FACTS')) / count(*) filter (where outcome <> 'DEFERRED_CORRECTLY') as accuracy,
(count(*) filter (where outcome = 'CORRECT') - count(*) filter (where outcome = 'CORRECT' and unportable)) / count(*) filter (where outcome <> 'DEFERRED_CORRECTLY') as strict_accuracy from {CASES} group by lang""")
def outcome_tally(spark, sf_dir):
    return stats.outcome_report(_cases(spark, sf_dir), ["lang"])


@R.df("""with e as (select value as total_ms, event_id % 3 = 0 as deferred, event_id % 11 = 0 as failed, event_id % 4 = 0 as cached from events), v as (select list_sort(list(total_ms)) as l, count(*) as n from e)
select count(*) as answers, count(*) filter (where deferred and not failed) as deferrals, count(*) filter (where failed) as errors, count(*) filter (where deferred and not failed) / (count(*) - count(*) filter (where failed)) as deferral_rate,
count(*) filter (where cached) / count(*) as cache_hit_rate, (select l[least(n - 1, cast(floor(0.5 * n) as bigint)) + 1] from v) as p50_ms, (select l[least(n - 1, cast(floor(0.95 * n) as bigint)) + 1] from v) as p95_ms from e""")
def slo_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    log = e.select(F.col("value").alias("total_ms"), (F.col("event_id") % 3 == 0).alias("deferred"), (F.col("event_id") % 11 == 0).alias("failed"), (F.col("event_id") % 4 == 0).alias("cached"))
    return stats.service_levels(log)


@R.df("""with r as (select year(o_orderdate) as run, count(*) filter (where o_orderstatus = 'F') / count(*) as accuracy from orders group by 1) select run, accuracy, accuracy - lag(accuracy) over (order by run) as change,
coalesce(accuracy - lag(accuracy) over (order by run) < -0.01, false) as regressed from r""")
def trend_lag(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("run")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("accuracy"))
    return stats.trend(runs, 0.01)


@R.df("select count(*) filter (where quality = 1 and toxic = 0) as only_a, count(*) filter (where quality = 0 and toxic = 1) as only_b from labels")
def mcnemar_pairs(spark, sf_dir):
    l = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    return stats.discordant(l.select("case_id", F.col("q").alias("correct")), l.select("case_id", F.col("t").alias("correct")))


@R.df("""with k as (select doc_id as case_id, quality = 1 as answerable, sha256('7' || chr(0) || doc_id) as h from labels), r as (select *, row_number() over (partition by answerable order by h) as n, count(*) over (partition by answerable) as size from k)
select case_id, answerable, case when n <= floor(size * 29 / 100) then 'held_out' else 'tuning' end as part from r""".replace("chr(0)", "decode('\\x00'::blob)"))
def sha_split(spark, sf_dir):
    cases = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("answerable"))
    return stats.split(cases, 7, "0.29")


@R.df("select threshold, count(*) filter (where value < threshold and event_id % 2 = 1) as wrong_caught, count(*) filter (where value < threshold and event_id % 2 = 0) as correct_lost from events, (values (10.0), (50.0)) t(threshold) group by 1")
def verify_replay(spark, sf_dir):
    scores = read(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("event_id") % 2 == 0).alias("correct"))
    return stats.verify_replay(scores, spark.createDataFrame([(10.0,), (50.0,)], "threshold double"))
