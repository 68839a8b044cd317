"""Windowed counts of a stream of events, each with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read
from ..streaming.counts import run_once, session_counts, windowed_counts
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


@R.df("select time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as start, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    return windowed_counts(read(spark, sf_dir, "events"), "1 hour")


@R.df("select time_bucket(interval 30 minute, ts, timestamp '1970-01-01') - k * interval 30 minute as start, event_type, count(*) as n from events, (values (0), (1)) t(k) group by 1, 2")
def stream_sliding_counts(spark, sf_dir):
    return windowed_counts(read(spark, sf_dir, "events"), "1 hour", "30 minutes")


@R.df("""with f as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as g from f)
select user_id, min(ts) as start, count(*) as n from s group by user_id, g""")
def stream_session_counts(spark, sf_dir):
    return session_counts(read(spark, sf_dir, "events"), "6 hours")


def _streamed(spark, sf_dir, query):
    """The events as a stream of files, run to its end: an event long after all others lets the watermark pass them."""
    from .sourcing import folder

    path, events = folder(spark), read(spark, sf_dir, "events")
    last = events.agg((F.max("ts") + F.expr("interval 4000 days")).alias("ts")).select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
    events.repartition(4).write.parquet(f"{path}/in")
    last.coalesce(1).write.mode("append").parquet(f"{path}/in")
    run_once(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", query)
    return spark.read.parquet(f"{path}/out")


@R.df(ORACLE_SQL["stream_tumbling_counts"])
def stream_run_tumbling(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda df: windowed_counts(df, "1 hour", late="3000 days")).where("event_type is not null")


@R.df(ORACLE_SQL["stream_session_counts"])
def stream_run_sessions(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda df: session_counts(df, "6 hours", late="3000 days")).where("user_id is not null")
