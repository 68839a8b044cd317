"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format as c

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    seventh = spark.sql(r"""select -7L conv_id, turn, role, r'\### Assistant: </turn> ok' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)""")
    records = rows.unionByName(seventh)
    turns = c.canonical_turns(records, F.to_variant_object(F.struct("role", "text")))
    done = c.format_conversations(turns)
    back = done.withColumns({"t": c.parse_formatted(F.col("formatted")), "loss": c.loss_text(F.col("formatted"), F.col("loss_mask"))})
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as c

    found = c.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(c.spans_text(base), 256).alias("base_sha256"), c.spans_text(F.col("spans")).alias("spans"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe as c

    both = c.decode(c.encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join as c

    return c.join(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import multi_index as c

    return c.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup as c

    return c.repeats(table(spark, sf_dir, "documents"), line_words=c.LINE_WORDS)


def op8_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hilbert as c

    return c.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ordinal as c

    docs = table(spark, sf_dir, "documents")
    model = c.fit(docs, c.ratings(table(spark, sf_dir, "labels")), c.GRADES)
    graded = c.score(docs.select("doc_id", "text"), model, c.GOOD)
    return graded.select("doc_id", "expected_grade", F.col("tail").alias("p_good"), (F.col("tail") >= 0.5).alias("kept"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc as c

    back = c.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing as c

    pieces = c.cut(table(spark, sf_dir, "documents"))
    summed = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "task", "rank")
    return c.place(summed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe": op3_bpe,
    "op4_near_vectors": op4_near_vectors,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_hilbert_search": op8_hilbert_search,
    "op9_quality": op9_quality,
    "op10_jaccard_join": op10_jaccard_join,
}

def _secret_sql() -> str:
    """Spans from the pieces that each expression splits a text into, and the matches between them. RE2 folds cases beyond
    ASCII, so letters are spelt in both."""
    import re

    from .secret_scan import RULES

    columns, lists = [], []
    for n, r in enumerate(RULES):
        regex = re.sub(r"(?<!\\)[a-z](?![^\[]*\])", lambda m: f"[{m[0].upper()}{m[0]}]", r.regex.replace("\\x20", " ")) if r.any_case else r.regex
        regex = regex.replace("'", "''")
        columns += [f"list_transform(string_split_regex(t, '{regex}'), lambda x: length(x)) as p{n}", f"list_transform(regexp_extract_all(t, '{regex}'), lambda x: length(x)) as m{n}", f"list_transform(regexp_extract_all(t, '{regex}', {r.group}), lambda x: length(x)) as g{n}"]
        lists.append(
            f"list_filter(list_transform(range(1, len(m{n}) + 1), lambda i: {{'s': cast(list_sum(p{n}[1:i]) + coalesce(list_sum(m{n}[1:i-1]), 0) as bigint), 'r': {n}, 'n': m{n}[i], 'g': g{n}[i], 'k': '{r.kind}'}}), lambda x: x.g >= {r.least})"
        )
    joined = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || (x.s + x.n)), ',')"
    base = "list_filter(f, lambda x: x.r < 3)"
    return f"""with d as (select doc_id, coalesce("text", '') as t from documents), e as materialized (select doc_id, {', '.join(columns)} from d), s as (select doc_id, list_sort(flatten([{', '.join(lists)}])) as f from e)
select doc_id, cast(len(list_filter(f, lambda x: x.r = 0)) as bigint) as n_assign, cast(len(list_filter(f, lambda x: x.r = 1)) as bigint) as n_access, cast(len(list_filter(f, lambda x: x.r = 2)) as bigint) as n_hex,
sha256({joined.format(base)}) as base_sha256, {joined.format('f')} as spans from s"""


ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as body from conversations
  union all
  select -7, n, case when n = 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from (values (0), (1)) v(n)
), coded as (
  select *, replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e') as r,
    replace(replace(replace(body, '\', '\b'), '###', '\h'), '</turn>', '\e') as b from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(body) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then body else '' end, '' order by turn nulls first, role, body)) as loss_sha256,
  cast(sum(length(replace(r, ':', '\c')) + length(b) + 14) as bigint) as formatted_chars
from coded group by conv_id
""",
    "op6_warc": """
with q as (select page_id, coalesce(html, '') as h from pages), f as (select page_id, strlen(h) as payload_bytes, sha1(h) as x, min(page_id) over (partition by h) as first from q)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(x, cast(i // 8 * 10 + 1 as bigint), 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as bigint) + 1, 1)), '') as payload_digest,
case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f
""",
    "op4_near_vectors": """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null),
w as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as len from v),
l as (select a.vec_id as a, b.vec_id as b from w a join w b on a.label = b.label and a.vec_id <> b.vec_id where list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.98),
r(root, node) as (select vec_id, vec_id from embeddings union select r.root, l.b from r join l on r.node = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select node, min(root) as component_id from r group by node) c on c.node = e.vec_id
""",
    "op8_hilbert_search": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null),
s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda x, y: x + y) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) t where rank <= 20
""",
    "op10_jaccard_join": r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r(root, node) as (select doc_id, doc_id from documents union select r.root, e.b from r join e on r.node = e.a)
select documents.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents left join n using (doc_id) join (select node, min(root) as component_id from r group by node) c on c.node = documents.doc_id
""",
    "op2_secret_scan": _secret_sql(),
}
