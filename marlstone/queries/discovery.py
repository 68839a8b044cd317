"""Catalogue, profiles, keys, vocabularies, dependencies, values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import SENSITIVE_TOKENS
from ..operators import grounding, keys, profile, values
from ..session import TABLES, read
from ..sources import catalog
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
COLUMNS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}
CORE = tuple(sorted(COLUMNS))


def _profile_sql(table: str) -> str:
    return " union all ".join(f"select '{table}' as \"table\", '{c}' as \"column\", count(*) as row_count, count(distinct {c}) as distinct_count, count(*) - count({c}) as null_count from {table}" for c in COLUMNS[table])


def _tables(spark, sf_dir, names=CORE):
    return {n: read(spark, sf_dir, n) for n in names}


PROFILE = ("table", "column", "row_count", "distinct_count", "null_count")


@R.df(_profile_sql("lineitem"))
def profile_lineitem(spark, sf_dir):
    return profile.profile(read(spark, sf_dir, "lineitem"), "lineitem").select(*PROFILE)


@R.df(" union all ".join(_profile_sql(t) for t in CORE))
def profile_all_tables(spark, sf_dir):
    return profile.profile_all(_tables(spark, sf_dir)).select(*PROFILE)


@R.df("select 'events' as \"table\", 'value' as \"column\", count(*) as row_count, count(distinct value) as distinct_count, count(*) - count(value) as null_count from events")
def null_profile_events(spark, sf_dir):
    return profile.profile(read(spark, sf_dir, "events").select("value"), "events").select(*PROFILE)


@R.df(f"select \"table\", \"column\", distinct_count = row_count - null_count as is_unique from ({' union all '.join(_profile_sql(t) for t in CORE)})")
def key_facts(spark, sf_dir):
    return profile.key_facts(profile.profile_all(_tables(spark, sf_dir)))


def _types(kind):
    return {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}[kind]


@R.df(" union all ".join(f"""select '{t}' as "table", column_name as "column", case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double'
  when 'FLOAT[]' then 'array<float>' else 'timestamp_ntz' end as type, row_number() over () as ordinal from (describe select * from {t})""" for t in TABLES))
def schema_catalog(spark, sf_dir):
    return catalog.introspect({t: read(spark, sf_dir, t) for t in TABLES})


@R.df("select * from (values ('customer', 'changed'), ('region', 'dropped'), ('fresh', 'added'), ('nation', 'unchanged')) t(\"table\", change)")
def catalog_diff_added_dropped(spark, sf_dir):
    before = catalog.introspect(_tables(spark, sf_dir, ("customer", "nation", "region")))
    now = _tables(spark, sf_dir, ("customer", "nation"))
    now["customer"], now["fresh"] = now["customer"].drop("c_name"), now["nation"]
    return catalog.diff(before, catalog.introspect(now))


@R.df("select o_orderpriority as value, count(*) as n from orders group by 1 order by n desc, value limit 3")
def top_values_priority(spark, sf_dir):
    return profile.top_values(read(spark, sf_dir, "orders"), "o_orderpriority", 3)


CODED = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "events": "event_id ts user_id event_type value props", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}


@R.df(" union all ".join(f"""select '{t}' as "table", '{c}' as "column", cast({c} as varchar) as code, count(*) as n from {t} where {c} is not null and (select count(distinct {c}) between 1 and 25 and count(distinct {c}) < count(*) from {t})
and not regexp_matches('{c}', '_(id|identifier|name)$') and not regexp_matches('{c}', '{'|'.join(SENSITIVE_TOKENS)}') group by 3""" for t, columns in CODED.items() for c in columns.split()))
def code_vocabulary(spark, sf_dir):
    """Every column of four tables that looks coded, with its whole vocabulary."""
    tables = _tables(spark, sf_dir, tuple(CODED))
    return profile.code_vocabulary(tables, profile.profile_all(tables))


LABELS = """with t as (select 'labels' as "table", {c} as v, count(*) as n, count(distinct doc_id) = count(doc_id) as u from labels group by v) select "table", '{c}' as "column", '=' || v as label, n as n_rows, {u} as unique_columns from t"""


@R.df("""with d as (select * , case when quality = 1 then 1 else 0 end as flag from labels) select 'labels' as "table", 'flag' as "column", '=' || flag as label, count(*) as n_rows,
case when count(*) >= 2 and count(distinct k) = count(k) then 'k' else '' end as unique_columns from (select *, (row_number() over (partition by flag order by doc_id)) as k from d) group by flag""")
def partition_uniqueness_labels(spark, sf_dir):
    # k numbers the rows of each flag: it repeats in the table and is unique within either flag
    from pyspark.sql import Window

    d = read(spark, sf_dir, "labels").withColumn("flag", F.when(F.col("quality") == 1, 1).otherwise(0))
    d = d.select("flag", F.row_number().over(Window.partitionBy("flag").orderBy("doc_id")).alias("k"))
    found = profile.partition_uniqueness(d, "labels", profile.profile(d, "labels"))
    return found.where("column = 'flag'").select("table", "column", "label", "n_rows", F.array_join("unique_columns", ",").alias("unique_columns"))


@R.df("""select 'conversations' as "table", 'side' as "column", '=''' || side || '''' as label, count(*) as n_rows, case when count(*) >= 2 and count(distinct turn) = count(turn) then 'turn' else '' end as unique_columns
from (select case when role = 'assistant' then 'a' else 'o' end as side, turn from conversations) group by side""")
def partition_uniqueness_conversations(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.when(F.col("role") == "assistant", "a").otherwise("o").alias("side"), "turn")
    found = profile.partition_uniqueness(c, "conversations", profile.profile(c, "conversations"))
    return found.where("column = 'side'").select("table", "column", "label", "n_rows", F.array_join("unique_columns", ",").alias("unique_columns"))


def _fd_sql(table, pairs):
    return " union all ".join(f"select '{table}' as \"table\", '{a}' as determinant, '{b}' as dependent, (select coalesce(bool_and(d = 1), false) from (select count(distinct {b}) as d from {table} where {a} is not null group by {a})) as holds" for a, b in pairs)


PART_PAIRS = [("p_brand", "p_type"), ("p_partkey", "p_name"), ("p_name", "p_partkey"), ("p_brand", "p_size")]


@R.df(_fd_sql("part", PART_PAIRS))
def functional_dependencies_part(spark, sf_dir):
    return profile.functional_dependencies(read(spark, sf_dir, "part"), "part", PART_PAIRS)


@R.df(_fd_sql("nation", [("n_nationkey", "n_regionkey"), ("n_regionkey", "n_nationkey")]))
def fd_nation_region(spark, sf_dir):
    return profile.functional_dependencies(read(spark, sf_dir, "nation"), "nation", [("n_nationkey", "n_regionkey"), ("n_regionkey", "n_nationkey")])


@R.df("select distinct cast(c_nationkey as varchar) as code, n_name as meaning from customer join nation on c_nationkey = n_nationkey")
def lookup_grounding_nation(spark, sf_dir):
    return grounding.lookup(read(spark, sf_dir, "customer"), "c_nationkey", read(spark, sf_dir, "nation"), "n_nationkey")


@R.df("select distinct cast(n_nationkey as varchar) as code, n_name as meaning from nation")
def correlated_grounding(spark, sf_dir):
    return grounding.correlated(read(spark, sf_dir, "nation"), "n_nationkey")


@R.df("select code, meaning, source from (values ('F', 'finished', 'dictionary'), ('O', 'open', 'lookup'), ('P', 'pending', 'ontology')) t(code, meaning, source)")
def meaning_precedence(spark, sf_dir):
    status = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("code")).distinct()
    named = lambda source, pairs: F.struct(F.lit(source).alias("source"), F.create_map(*(F.lit(x) for p in pairs.items() for x in p)).alias("m"))
    sources = F.array(named("ontology", {"F": "f", "O": "o", "P": "pending"}), named("lookup", {"F": "done", "O": "open"}), named("dictionary", {"F": "finished"}))
    each = status.select("code", F.explode(sources).alias("s")).select("code", F.try_element_at("s.m", "code").alias("meaning"), "s.source").where("meaning is not null")
    return grounding.by_precedence(each)


INDEXED = [("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("orders", "o_orderstatus")]


def _index(spark, sf_dir):
    tables = _tables(spark, sf_dir, ("customer", "orders"))
    return values.build_index(tables, values.indexed_columns(tables, profile.profile_all(tables)))


INDEX_SQL = " union all ".join(f"select distinct '{t}' as \"table\", '{c}' as \"column\", {c} as value from {t}" for t, c in INDEXED)


@R.df(INDEX_SQL)
def value_index(spark, sf_dir):
    return _index(spark, sf_dir)


def _literals(spark, rows):
    return spark.createDataFrame(rows, "table string, column string, value string")


@R.df("select * from (values ('orders', 'o_orderstatus', 'X'), ('customer', 'c_mktsegment', 'building')) t(\"table\", \"column\", value)")
def value_absent(spark, sf_dir):
    asked = _literals(spark, [("orders", "o_orderstatus", "X"), ("orders", "o_orderstatus", "F"), ("customer", "c_mktsegment", "building"), ("customer", "c_name", "nobody")])
    return values.absent(_index(spark, sf_dir), asked)


@R.df("""with v as (select distinct o_orderpriority as near from orders), g(s, n) as (values ('urgent', 0)),
grams as (select near, list_distinct([substring('  ' || lower(near) || ' ', i, 3) for i in range(1, length(near) + 2)]) as t from v), q as (select list_distinct([substring('  urgent ', i, 3) for i in range(1, 8)]) as t)
select 'orders' as "table", 'o_orderpriority' as "column", 'urgent' as value, row_number() over (order by score desc, near) as rank, near, score from
(select near, len(list_intersect(grams.t, q.t)) / len(list_distinct(list_concat(grams.t, q.t))) as score from grams, q) order by score desc, near limit 3""")
def value_nearest_trigram(spark, sf_dir):
    return values.nearest(_index(spark, sf_dir), _literals(spark, [("orders", "o_orderpriority", "urgent")]), 3)


@R.df("select * from (values ('orders', 'o_orderstatus')) t(\"table\", \"column\")")
def value_holders(spark, sf_dir):
    return values.holders(_index(spark, sf_dir), "F")


@R.df("select o_orderpriority as value from (select distinct o_orderpriority from orders) order by 1 limit 4")
def value_first_held(spark, sf_dir):
    return values.first_values(read(spark, sf_dir, "orders"), "o_orderpriority", 4)


@R.df("select (select count(*) from lineitem) as children, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)) as orphans")
def inclusion_orphans(spark, sf_dir):
    return keys.orphans(read(spark, sf_dir, "lineitem"), "l_orderkey", read(spark, sf_dir, "orders"), "o_orderkey")


@R.df("""select children, orphans, children > 0 and orphans <= 0.05 * children as holds from (select count(*) as children, count(*) filter (where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)) as orphans from lineitem)""")
def fk_tolerant(spark, sf_dir):
    return keys.contained(read(spark, sf_dir, "lineitem"), "l_suppkey", read(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_suppkey")


@R.df("""select * from (values ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('lineitem', 'l_partkey', 'part', 'p_partkey'), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey'),
('nation', 'n_regionkey', 'region', 'r_regionkey'), ('orders', 'o_custkey', 'customer', 'c_custkey'), ('supplier', 's_nationkey', 'nation', 'n_nationkey')) t(child, "column", parent, parent_column)""")
def infer_keys_containment(spark, sf_dir):
    found = keys.infer_by_containment(_tables(spark, sf_dir))
    return spark.createDataFrame(found, "child string, column string, parent string, parent_column string")


@R.df("select * from (values ('child', 'parent_id', 'parent', 'parent_id')) t(child, \"column\", parent, parent_column)")
def infer_keys_by_name(spark, sf_dir):
    parent = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("parent_id"), "n_name")
    child = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child_id"), F.col("c_nationkey").alias("parent_id"))
    return spark.createDataFrame(keys.infer({"parent": parent, "child": child}), "child string, column string, parent string, parent_column string")


@R.df("select * from (values ('parcel', 'depot', 1, 'sent_from=code'), ('parcel', 'depot', 2, 'sent_to=code'), ('stop', 'tour', 3, 'day=day,van=van')) t(child, parent, constraint_id, join_keys)")
def declared_relationships(spark, sf_dir):
    rows = [("parcel", "sent_from", "depot", "code", 1, 0), ("parcel", "sent_to", "depot", "code", 2, 0), ("stop", "van", "tour", "van", 3, 1), ("stop", "day", "tour", "day", 3, 0)]
    return keys.declared(spark.createDataFrame(rows, "child string, column string, parent string, parent_column string, constraint_id int, position int"))


@R.df("select count(*) filter (where try_cast(c_mktsegment as int) is null) as lost from customer")
def cast_loss(spark, sf_dir):
    return keys.cast_is_lossless(read(spark, sf_dir, "customer"), "c_mktsegment", "int")


@R.df("""select 'customer.nation_name' as "column", 'nations' as scheme_id""")
def scheme_binding(spark, sf_dir):
    return grounding.bind(_scores(spark, sf_dir))


@R.df("""select * from (values ('customer.nation_name', 'nations', 25, 25), ('orders.nation_name', 'nations', 25, 25)) t("column", scheme_id, matched, considered) where "column" = 'customer.nation_name'""")
def scheme_scores(spark, sf_dir):
    return _scores(spark, sf_dir).where("matched > 0 and column = 'customer.nation_name'").select("column", "scheme_id", "matched", "considered")


def _scores(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    held = [nation.select(F.lit("customer.nation_name").alias("column"), F.col("n_name").alias("value")), spark.createDataFrame([("customer.nation_name", "N/A")], "column string, value string")]
    schemes = [nation.select(F.lit("nations").alias("scheme_id"), F.lit("Nation Codes").alias("label"), F.upper("n_name").alias("notation")), read(spark, sf_dir, "region").select(F.lit("regions").alias("scheme_id"), F.lit("Regions").alias("label"), F.col("r_name").alias("notation"))]
    scores = grounding.scheme_scores(reduce(lambda a, b: a.unionByName(b), held).withColumn("column", F.lit("nation_name")), reduce(lambda a, b: a.unionByName(b), schemes))
    return scores.withColumn("column", F.lit("customer.nation_name"))
