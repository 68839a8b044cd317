"""BM25, cosine, fusion, trigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import retrieve
from ..session import TABLES, read
from ..sources import catalog
from .base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
ASK = "the and tion"
BM25_SQL = """with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce("text", '')), '[^a-z0-9]+'), lambda x: x <> '') as w from documents),
tf as (select doc_id, len(w) as dl, {tfs} from w), f as (select count(*) as n, avg(dl) as avgdl, {dfs} from tf),
s as (select doc_id, {score} as score from tf, f where {hit})"""
WORDS = sorted(set(retrieve.query_terms(ASK)))
BM25_SQL = BM25_SQL.format(
    tfs=", ".join(f"len(list_filter(w, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(WORDS)), dfs=", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(WORDS))),
    score=" + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * cast(tf{i} as double) * (1.2e0 + 1) / (cast(tf{i} as double) + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))" for i in range(len(WORDS))),
    hit=" or ".join(f"tf{i} > 0" for i in range(len(WORDS))),
)


@R.df(BM25_SQL + " select doc_id, round(score, 6) as score from s")
def bm25_documents(spark, sf_dir):
    return retrieve.bm25(read(spark, sf_dir, "documents"), ASK).select("doc_id", F.round("score", 6).alias("score"))


QUERY_VECTOR = "(select list_transform(embedding, lambda x: cast(x as double)) from embeddings where vec_id = 7)"
COSINE_SQL = f"select vec_id, list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), {QUERY_VECTOR}) as score from embeddings"


def _query(spark, sf_dir):
    return [float(x) for x in read(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]]


@R.df(f"select vec_id, round(score, 6) as score, row_number() over (order by score desc, vec_id) as rank from ({COSINE_SQL}) order by score desc, vec_id limit 10")
def cosine_topk(spark, sf_dir):
    found = retrieve.nearest(read(spark, sf_dir, "embeddings"), _query(spark, sf_dir), k=10)
    return found.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@R.df(BM25_SQL + f""", a as (select doc_id as id, row_number() over (order by score desc, doc_id) as r from s order by r limit 20), b as (select vec_id as id, row_number() over (order by score desc, vec_id) as r from ({COSINE_SQL}) order by r limit 20)
select coalesce(a.id, b.id) as id, round(coalesce(1e0 / (60 + a.r), 0) + coalesce(1e0 / (60 + b.r), 0), 9) as score from a full outer join b on a.id = b.id order by coalesce(1e0 / (60 + a.r), 0) + coalesce(1e0 / (60 + b.r), 0) desc, 1 limit 10""")
def rrf_fusion(spark, sf_dir):
    a = retrieve.bm25(read(spark, sf_dir, "documents"), ASK, k=20).withColumnRenamed("doc_id", "id")
    b = retrieve.nearest(read(spark, sf_dir, "embeddings"), _query(spark, sf_dir), k=20).withColumnRenamed("vec_id", "id")
    return retrieve.fuse(a, b, "id", 10).select("id", F.round("score", 9).alias("score"))


GRAMS = "list_distinct([substring('  ' || lower({c}) || ' ', i, 3) for i in range(1, length({c}) + 2)])"


@R.df(f"""with g as (select n_name, {GRAMS.format(c='n_name')} as t from nation) select a.n_name as a, b.n_name as b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) as similarity,
len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) as overlap from g a join g b on a.n_name < b.n_name""")
def trigram_pairs(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a")), n.select(F.col("n_name").alias("b"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", t.similarity("a", "b").alias("similarity"), t.overlap("a", "b").alias("overlap"))


# of the seven trigrams of "  origin ", all but the first stand in "  sample origin "
@R.df("select * from (values ('origin_cd', 'Sample Origin Classification', round(6e0 / 7, 3)), ('id', 'List', 0e0)) t(name, label, affinity)")
def name_affinity(spark, sf_dir):
    pairs = spark.createDataFrame([("origin_cd", "Sample Origin Classification"), ("id", "List")], "name string, label string")
    return pairs.select("name", "label", F.round(t.affinity("name", "label"), 3).alias("affinity"))


@R.df("select * from (values ('customerID', 'customer id'), ('order_line_no', 'order line no'), ('HTTPStatus2', 'httpstatus2')) t(name, words)")
def normalized_names(spark, sf_dir):
    return spark.createDataFrame([("customerID",), ("order_line_no",), ("HTTPStatus2",)], "name string").select("name", t.normalized("name").alias("words"))


@R.df("select * from (values (1, 'jdbc:postgresql://***@h/db failed'), (2, 'host=h password=*** user=u'), (3, 'nothing')) t(n, msg)")
def scrubbed_credentials(spark, sf_dir):
    rows = [(1, "jdbc:postgresql://bob:pw@h/db failed"), (2, "host=h password='a b' user=u"), (3, "nothing")]
    return spark.createDataFrame(rows, "n int, m string").select("n", t.scrub_credentials("m").alias("msg"))


@R.df("select 'region' as \"table\", 'region' || chr(10) || 'r_regionkey int' || chr(10) || 'r_name string' as \"text\"")
def schema_cards(spark, sf_dir):
    columns = catalog.introspect({n: read(spark, sf_dir, n) for n in TABLES})
    return retrieve.visible(retrieve.cards(columns), ["region"])


@R.df("select * from (values ('a', 3), ('b', 7)) t(item, used)")
def prompt_fit(spark, sf_dir):
    items = spark.createDataFrame([(1, 1, 3, "a"), (1, 2, 4, "b"), (2, 1, 9, "c"), (2, 2, 1, "d")], "tier int, ordinal int, tokens int, item string")
    return retrieve.fit(items, 10).select("item", "used")
