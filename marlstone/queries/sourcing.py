"""Tables through other formats and back, merged sources, snapshots, caches and time limits."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import functions as F

from ..operators import grounding, snapshot
from ..plans.policy import Grants
from ..session import TABLES, read
from ..sources import catalog, files, questions
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


def folder(spark) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, else a temporary one of a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/sourcing-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="marlstone-sourcing-")
    atexit.register(shutil.rmtree, path, True)
    return path


@R.df("select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def csv_seed(spark, sf_dir):
    path = f"{folder(spark)}/customer"
    read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias('name, "in full"'), "c_nationkey", "c_mktsegment").write.option("header", True).option("escape", '"').csv(path)
    back = files.read_csv(spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col('name, "in full"').alias("c_name"), F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment")


@R.df("select n_nationkey, n_name, n_regionkey from nation")
def sqlite_source(spark, sf_dir):
    import sqlite3
    from contextlib import closing

    path = f"{tempfile.mkdtemp(prefix='marlstone-sqlite-')}/s.db"  # a SQLite file lies where its reader's one task runs
    atexit.register(shutil.rmtree, path.rsplit("/", 1)[0], True)
    rows = [tuple(r) for r in read(spark, sf_dir, "nation").collect()]  # 25 rows
    with closing(sqlite3.connect(path)) as con:
        con.execute("create table nation (n_nationkey integer, n_name text, n_regionkey integer)")
        con.executemany("insert into nation values (?, ?, ?)", rows)
        con.commit()
    return files.read_sqlite(spark, path, "nation")


@R.df("select o_orderpriority, count(*) as n, min(o_orderdate) as first, avg(o_totalprice) as mean from orders group by 1")
def arrow_stream(spark, sf_dir):
    out = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"), F.avg("o_totalprice").alias("mean"))
    return spark.createDataFrame(files.from_ipc(files.to_ipc(out)))


@R.df("select s_suppkey, s_name, s_acctbal from supplier union all select s_suppkey, s_name, s_acctbal from supplier where s_acctbal < 0")
def parquet_export_and_append(spark, sf_dir):
    path, s = folder(spark), read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    files.export({"supplier": s}, path, max_records=300)
    files.append(s.where("s_acctbal < 0"), f"{path}/supplier")
    return files.read_parquet(spark, f"{path}/supplier")


@R.df("select r_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
def federated_join(spark, sf_dir):
    """Two sources in one namespace; names of three parts become views of one."""
    crm, geo = {"customer": read(spark, sf_dir, "customer")}, {t: read(spark, sf_dir, t) for t in ("nation", "region")}
    own = spark.newSession()
    tables = catalog.federated({"crm": {t: read(own, sf_dir, t) for t in crm}, "geo": {t: read(own, sf_dir, t) for t in geo}})
    catalog.register_federated(tables)
    return own.sql("select r_name, count(*) as customers from crm__customer join geo__nation on c_nationkey = n_nationkey join geo__region on n_regionkey = r_regionkey group by r_name")


@R.df("select table_name as \"table\" from information_schema.tables where table_name like '%s' or table_name = 'part'")
def scoped_tables(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in catalog.scoped(catalog.tables_at(spark, sf_dir), ["*S", "Part"])], "table string")


@R.df(" union all ".join(f"select '{t}' as \"table\", count(*) as n from {t}" for t in TABLES))
def table_sizes(spark, sf_dir):
    return spark.createDataFrame([(t, catalog.table_size(read(spark, sf_dir, t))) for t in TABLES], "table string, n long")


@R.df("select * from (values ('abs', 'system'), ('count', 'system'), ('sum', 'system'), ('concat', 'system')) t(function, kind) where function in (select function_name from duckdb_functions())")
def function_inventory(spark, sf_dir):
    return catalog.functions(spark).where(F.col("function").isin("abs", "count", "sum", "concat"))


SNAP = ("customer", "nation", "region")


@R.df(" union all ".join(f"""select '{p}.{t}' as "table", column_name as "column", row_number() over () as ordinal from (describe select * from {t})""" for p, t in (("a", "nation"), ("a", "region"), ("b", "customer"))))
def snapshots_saved_and_merged(spark, sf_dir):
    path = folder(spark)
    for version, tables in (("v1", ("nation", "region")), ("v2", ("customer",))):
        catalog.save_snapshot({"columns": catalog.introspect({t: read(spark, sf_dir, t) for t in tables})}, path, version)
    loaded = {s: catalog.load_snapshot(spark, path, ["columns"], v) for s, v in (("a", "v1"), ("b", "v2"))}
    return catalog.merge_snapshots(loaded)["columns"].select("table", "column", "ordinal")


@R.df("""select 'nation' as "table", 'open' as job, 'done' as state, 'in part' as described union all select 'nation', 'profile', 'done', 'in part' union all select 'region', 'open', 'done', 'in part' union all select 'region', 'profile', 'done', 'in part'
union all select 'lost', 'open', case when 'lost' in (select table_name from information_schema.tables) then 'done' else 'failed' end, 'in part' union all select '*', 'joins', 'done', 'in part'""")
def snapshot_jobs(spark, sf_dir):
    _, jobs = snapshot.build(spark, {t: (lambda t=t: read(spark, sf_dir, t)) for t in ("nation", "region", "lost")})
    return jobs.select("table", "job", "state", F.lit(snapshot.describes(jobs)).alias("described"))


@R.df(" union all ".join(f"""select '{t}' as "table", '{c}' as "column", count(*) as row_count, count(distinct {c}) as distinct_count, count(*) filter (where {c} is null) as null_count from {t}""" for t, cols in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("region", ("r_regionkey", "r_name"))) for c in cols))
def snapshot_profiles(spark, sf_dir):
    parts, _ = snapshot.build(spark, {t: (lambda t=t: read(spark, sf_dir, t)) for t in ("nation", "region", "lost")})
    return parts["profiles"].select("table", "column", "row_count", "distinct_count", "null_count")


@R.df("""select 'a' as name, count(*) as n from orders where o_orderstatus = 'F' union all select 'b', count(*) from orders where o_orderstatus = 'O' union all select 'hits', 2""")
def result_cache(spark, sf_dir):
    cache, made = catalog.ResultCache(10**6), []

    def count(status):
        made.append(status)
        return read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).agg(F.count(F.lit(1)).alias("n"))

    asked = [("a", "F"), ("b", "O"), ("a", "F"), ("b", "O")]
    got = {name: cache.get((name, "grants", 1), lambda s=s: count(s)).to_pylist()[0]["n"] for name, s in asked}
    return spark.createDataFrame([*got.items(), ("hits", len(asked) - len(made))], "name string, n long")


@R.df("select 'in time' as run, count(*) as n from nation union all select 'stopped', null")
def time_limit(spark, sf_dir):
    out = [("in time", files.bounded(spark, lambda: read(spark, sf_dir, "nation").count(), 600))]
    slow = spark.range(0, 10**13, 1, 4).selectExpr("sum(sqrt(id))")
    try:
        files.bounded(spark, slow.collect, 0.5)
        out.append(("finished", None))
    except files.QueryTimeout:
        out.append(("stopped", None))
    return spark.createDataFrame(out, "run string, n long")


@R.df("select 'v_big' as \"view\", 'select o_orderkey, o_custkey from orders where o_totalprice > 400000' as body, (select count(*) from orders where o_totalprice > 400000) as n union all select 'v_two', 'select count(*) as n from v_big join nation on o_custkey = n_nationkey', (select count(*) from orders join nation on o_custkey = n_nationkey where o_totalprice > 400000)")
def view_definitions(spark, sf_dir):
    own = spark.newSession()
    for t in ("orders", "nation"):
        read(own, sf_dir, t).createOrReplaceTempView(t)
    bodies = {"v_big": "select o_orderkey, o_custkey from orders where o_totalprice > 400000", "v_two": "select count(*) as n from v_big join nation on o_custkey = n_nationkey"}
    for name, body in bodies.items():
        own.sql(f"create temporary view {name} as {body}")
    sizes = {"v_big": own.table("v_big").count(), "v_two": own.table("v_two").first()["n"]}
    found = {r["view"]: r["body"] for r in snapshot.views(own, bodies).collect()}
    return spark.createDataFrame([(v, found[v], n) for v, n in sizes.items()], "view string, body string, n long")


@R.df("""select 'c1.csv' as file, count(*) as n, min(o_orderstatus) as low from orders where o_orderstatus <= 'F' union all select 'c1_alt.csv', count(*), min(o_orderstatus) from orders where o_orderstatus > 'F'""")
def gold_alternatives(spark, sf_dir):
    path, o = folder(spark), read(spark, sf_dir, "orders")
    for name, where in (("c1.csv", "o_orderstatus <= 'F'"), ("c1_alt.csv", "o_orderstatus > 'F'"), ("c10.csv", "true"), ("c2.csv", "true")):
        files.write_one_csv(o.where(where).groupBy("o_orderstatus").count(), path, name)
    out = None
    for name, df in questions.gold_results(spark, path, "c1").items():
        one = df.select(F.lit(name).alias("file"), F.col("count").cast("long").alias("n"), F.col("o_orderstatus").alias("low")).groupBy("file").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
        out = one if out is None else out.unionByName(one)
    return out


@R.df("""with q as (select 'How many orders of ' || c_custkey || '?' as question, 'select count(*) from orders where o_custkey = ' || c_custkey as gold_sql from customer where c_custkey % 7 = 0)
select left(sha256(question || chr(0) || gold_sql), 12) as case_id, question, gold_sql, cast(null as varchar) as source from q""".replace("chr(0)", "decode('\\x00'::blob)"))
def question_set(spark, sf_dir):
    path = f"{folder(spark)}/questions"
    c = read(spark, sf_dir, "customer").where("c_custkey % 7 = 0")
    asked = c.select(F.concat(F.lit("  How many orders of "), "c_custkey", F.lit("? ")).alias("question"), F.concat(F.lit("select count(*) from orders where o_custkey = "), "c_custkey").alias("sql"))
    asked.unionByName(spark.createDataFrame([(" ", "select 1"), (None, "select 2")], asked.schema)).write.parquet(path)
    return questions.load_questions(spark, path)


@R.df("""select column_name as "column", case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' else 'string' end as type from (describe select * from customer)""")
def ddl_of_another_system(spark, sf_dir):
    ddl = """CREATE TABLE [dbo].[customer] ( -- people
      [c_custkey] BIGINT NOT NULL IDENTITY(1,1), c_name NVARCHAR(50), "c_nationkey" int, c_acctbal FLOAT DEFAULT (0.0), c_mktsegment char(10),
      CONSTRAINT pk PRIMARY KEY (c_custkey)
    ) GO"""
    return spark.createDataFrame(questions.columns_of_ddl(ddl)["customer"], "column string, type string")


@R.df("""select 'http://x/regions/' || r_regionkey as scheme_id, r_name as scheme_label, cast(n_nationkey as varchar) as notation, n_name as label, list_sort([lower(n_name), 'nation ' || n_nationkey]) as also
from nation join region on n_regionkey = r_regionkey""")
def vocabulary_digest(spark, sf_dir):
    path = f"{folder(spark)}/concepts"
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    line = lambda s, p, o: F.concat(s, F.lit(f" <http://www.w3.org/2004/02/skos/core#{p}> "), o, F.lit(" ."))
    quoted = lambda c, tag="": F.concat(F.lit('"'), c, F.lit(f'"{tag}'))
    nation, region = F.concat(F.lit("<http://x/n/"), "n_nationkey", F.lit(">")), F.concat(F.lit("<http://x/regions/"), "n_regionkey", F.lit(">"))
    facts = F.array(
        line(nation, "inScheme", region), line(nation, "notation", quoted(F.col("n_nationkey").cast("string"))), line(nation, "prefLabel", quoted(F.col("n_name"), "@en")),
        line(nation, "altLabel", quoted(F.lower("n_name"))), line(nation, "altLabel", quoted(F.concat(F.lit("nation "), "n_nationkey"))),
    )
    schemes = r.select(line(F.concat(F.lit("<http://x/regions/"), "r_regionkey", F.lit(">")), "prefLabel", quoted(F.col("r_name"))).alias("value"))
    n.select(F.explode(facts).alias("value")).unionByName(schemes).write.text(path)
    return grounding.digest(grounding.read_triples(spark, path))


@R.df("select 'How many?' as question, ['orders'] as tables union all select 'Which segments?', ['customer']")
def verified_examples(spark, sf_dir):
    from .rulings import _with

    secured = _with(spark, sf_dir, ["orders", "customer"])
    asked = [("How many?", "select count(*) as n from orders"), ("None such", "select o_orderkey from orders where o_totalprice < 0"), ("Everything", "select * from orders"), ("Which segments?", "select distinct c_mktsegment from customer"),
             ("Again", "select max(o_totalprice) as m from orders"), ("Of others", "select count(*) as n from part")]
    kept = snapshot.verified_examples(secured, asked, most=1)
    return spark.createDataFrame([(q, list(t)) for q, _, t in kept], "question string, tables array<string>")


@R.df("""select 'customer' as "table", column_name as "column" from (describe select * from customer) where column_name not in ('c_acctbal', 'c_mktsegment') union all select 'nation', column_name from (describe select * from nation)""")
def locatable_columns(spark, sf_dir):
    columns = catalog.introspect({t: read(spark, sf_dir, t) for t in ("customer", "nation", "region")})
    return snapshot.locatable(columns, ["customer", "nation"], {("customer", "c_acctbal"): frozenset({"pii"})}, frozenset({("customer", "c_mktsegment")})).select("table", "column")
