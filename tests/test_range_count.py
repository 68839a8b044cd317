"""Counts over ranges of time, against Spark's own window and DuckDB's."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from compare_oracle import rows
from marlstone.operators.windows import range_count
from marlstone.plans.decide import decide
from marlstone.plans.policy import Grants, secured_session
from marlstone.plans.rewrite import rewritten
from marlstone.plans.tree import optimized
from marlstone.queries import catalogue

T0, DAY, MICRO = dt.datetime(2024, 1, 1, 23, 59, 59, 999_999), dt.timedelta(days=1), dt.timedelta(microseconds=1)
AT = [T0, T0, T0 + MICRO, T0 + 7 * DAY, T0 + 7 * DAY + MICRO, T0 + 7 * DAY + 2 * MICRO, T0 + 8 * DAY, T0 + 300 * DAY, dt.datetime(1969, 12, 31, 23), dt.datetime(1970, 1, 7, 23), None, None]
WEEK = "range between interval '7' day preceding and current row"
COUNTED = {
    "one key": f"select id, count(*) over (partition by kind order by ts {WEEK}) as n from marks",
    "two keys": f"select id, count(*) over (partition by kind, part order by ts {WEEK}) as n from marks",
    "no key": f"select id, count(*) over (order by ts {WEEK}) as n from marks",
    "of rows that are left": f"select part, n, id from (select id, part, count(1) over (partition by kind order by ts {WEEK}) as n from marks where part > 0) t",
    "hours": "select id, count(*) over (partition by kind order by ts range between interval '36' hour preceding and current row) as n from marks",
    "of a point": "select id, count(*) over (partition by kind order by ts range between interval '0' day preceding and current row) as n from marks",
    "nulls last": f"select id, count(*) over (partition by kind order by ts nulls last {WEEK}) as n from marks",
}
LEFT = {
    "values": f"select id, count(part) over (partition by kind order by ts {WEEK}) as n from marks",
    "descending": f"select id, count(*) over (partition by kind order by ts desc {WEEK}) as n from marks",
    "whole past": "select id, count(*) over (partition by kind order by ts range between unbounded preceding and current row) as n from marks",
    "two counts": f"select id, count(*) over (partition by kind order by ts {WEEK}) as n, count(*) over (partition by part order by ts {WEEK}) as m from marks",
    "by chance": f"select id, count(*) over (partition by kind order by ts {WEEK}) as n from (select * from marks where rand() >= 0) t",
    "further on": "select id, count(*) over (partition by kind order by ts range between current row and interval '7' day following) as n from marks",
}


def ranged(df):
    return [n for n in optimized(df).walk() if n.kind == "SpecifiedWindowFrame" and "RangeFrame" in str(n.fields)]


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    import pyarrow as pa

    s, con = spark.newSession(), duckdb.connect()
    data = [(i, kind, i % 3 if i % 5 else None, at) for i, (kind, at) in enumerate((k, a) for k in ("a", "b", None) for a in AT)]
    s.createDataFrame(data, "id long, kind string, part long, ts timestamp_ntz").write.mode("overwrite").parquet(path := str(tmp_path_factory.mktemp("marks") / "marks"))
    s.read.parquet(path).createOrReplaceTempView("marks")
    con.register("given", pa.table({n: [r[i] for r in data] for i, n in enumerate(("id", "kind", "part", "ts"))}))
    con.execute("create table marks as select * from given")
    return s, con, path


@pytest.mark.parametrize("name", ["window_range_7d", "approved_window_range_7d"])
def test_range_queries_have_no_range_window(spark, sf_dir, name):
    assert not ranged(catalogue()[0][name](spark, sf_dir))


@pytest.mark.parametrize("name", sorted(COUNTED))
def test_counts_equal_the_window(own, name):
    s, con, _ = own
    df = s.sql(COUNTED[name])
    out = rewritten(df)
    assert ranged(df) and not ranged(out) and out.schema == df.schema
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    assert got == rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(COUNTED[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(LEFT))
def test_other_windows_stay_as_they_are(own, name):
    df = own[0].sql(LEFT[name])
    assert rewritten(df) is df


@pytest.mark.parametrize("filters", [{}, {"marks": "part > 0"}])
def test_counts_stay_behind_row_filters(spark, own, filters):
    secured = secured_session(spark, lambda s, n: s.read.parquet(own[2]), ["marks"], Grants(frozenset({"marks"}), filters=filters))
    got = sorted(tuple(r) for r in decide(secured, COUNTED["one key"]).df.collect())
    where = "where part > 0" if filters else ""
    assert got == sorted(own[1].execute(COUNTED["one key"].replace("from marks", f"from marks {where}")).fetchall())


def test_counts_meet_their_rows_by_time_first(own):
    """A struct alone as the join's key makes Spark's sort compare it field by field."""
    s, con, _ = own
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rewritten(s.sql(COUNTED["one key"]))
        assert "SortMergeJoin [coalesce(" in out._jdf.queryExecution().sparkPlan().toString()
        assert sorted(tuple(r) for r in out.collect()) == sorted(con.execute(COUNTED["one key"]).fetchall())
    finally:
        s.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_no_time_is_not_the_epoch(spark, kind):
    data = [(1, None), (2, dt.datetime(1970, 1, 1)), (3, None), (4, dt.datetime(1970, 1, 1)), (5, dt.datetime(1970, 1, 3)), (6, None)]
    df = spark.createDataFrame(data, f"id long, ts {kind}")
    out = range_count(df, [], "ts", F.expr("ts - interval '7' day"), "n")
    assert sorted(tuple(r) for r in out.select("id", "n").collect()) == [(1, 3), (2, 2), (3, 3), (4, 2), (5, 3), (6, 3)]


def test_approved_query_opens_only_tables_that_it_names(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    out = catalogue()[0]["approved_window_range_7d"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    assert sorted(tuple(r) for r in out.collect()) == sorted(con.execute(catalogue()[1]["approved_window_range_7d"]).fetchall())
