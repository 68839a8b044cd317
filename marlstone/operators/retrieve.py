"""Ranking of context: BM25, cosine, reciprocal-rank fusion, what an identity may see filtered before ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, terms

#: Fixed values of the rankings.
K1, B, RRF = 1.2, 0.75, 60


def cards(columns: DataFrame) -> DataFrame:
    """One document per table of columns (table, column, type, ordinal)."""
    line = F.concat_ws(" ", "column", "type")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"])
    return columns.groupBy("table").agg(F.concat_ws("\n", F.first("table"), F.array_join(listed, "\n")).alias("text"))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """Rows (id, score, rank) of documents that hold a term of ``query``, ties by id.

    Corpus figures and term counts of the query's own terms alone are made in one pass each; no inverted table of all terms
    is shuffled.
    """
    words = sorted(set(query_terms(query)))
    split = docs.select(F.col(id_col).alias("id"), terms(F.coalesce(text_col, F.lit(""))).alias("w"))
    own = split.select("id", F.size("w").alias("dl"), F.filter("w", lambda t: t.isin(*words)).alias("w"))  # the query's terms only
    counted = own.select("id", "dl", *(_times(w).alias(f"tf{i}") for i, w in enumerate(words)))
    figures = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    both = counted.crossJoin(F.broadcast(figures))  # one row
    score: Column = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = F.lit(False)
    for i in range(len(words)):
        hit = hit | (F.col(f"tf{i}") > 0)
    return ranked(both.where(hit).select(F.col("id").alias(id_col), score.alias("score")), id_col, k)


def _times(word: str) -> Column:
    return F.size(F.filter("w", lambda t: t == word))


def query_terms(query: str) -> list[str]:
    import re

    return [w for w in re.split("[^a-z0-9]+", query.lower()) if w]


def nearest(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vec_col: str = "embedding", k: int | None = None) -> DataFrame:
    """Rows (id, score, rank) by cosine, ties by id; vectors of another width are refused loudly."""
    width = len(query)
    checked = F.when(F.size(vec_col) == width, F.col(vec_col)).otherwise(F.raise_error(F.lit(f"embedding is not {width} wide")))
    q = F.array(*(F.lit(float(x)) for x in query))
    return ranked(vectors.select(id_col, cosine(checked, q).alias("score")).where("score is not null"), id_col, k)


def ranked(scored: DataFrame, id_col: str, k: int | None) -> DataFrame:
    """With ``rank`` from 1; with ``k``, a bounded sort per task before the numbering."""
    best = scored.orderBy(F.desc("score"), id_col).limit(k) if k else scored
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def fuse(a: DataFrame, b: DataFrame, id_col: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of two rankings, ties by id."""
    x, y = a.select(id_col, F.col("rank").alias("ra")), b.select(id_col, F.col("rank").alias("rb"))
    part = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    return ranked(x.join(y, id_col, "full").select(id_col, (part("ra") + part("rb")).alias("score")), id_col, k)


def visible(docs: DataFrame, granted: list[str], col: str = "table") -> DataFrame:
    """Only what is granted, before any ranking."""
    return docs.where(F.col(col).isin(*granted)) if granted else docs.limit(0)


def examples_visible(examples: DataFrame, granted: list[str]) -> DataFrame:
    """Examples (question, sql, tables) all of whose tables are granted."""
    return examples.where(F.forall("tables", lambda t: t.isin(*granted)) & (F.size("tables") > 0)) if granted else examples.limit(0)


def fit(items: DataFrame, budget: int) -> DataFrame:
    """Items (tier, ordinal, tokens, item) in order, as many as the budget holds; the first that doesn't fit ends it."""
    w = Window.orderBy("tier", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def examples_like(examples: DataFrame, query: list[float], granted: list[str], open_columns: list[str], k: int) -> DataFrame:
    """The ``k`` examples (question, sql, tables, columns as table.column, embedding) nearest to a question, of those all of
    whose tables are granted and all of whose columns may be read as they are. Nothing else is scored."""
    fine = examples_visible(examples, granted)
    readable = F.forall("columns", lambda c: c.isin(*open_columns)) if open_columns else F.size("columns") == 0
    return nearest(fine.where(readable), query, "question", "embedding", k)


def definitions_like(definitions: DataFrame, query: list[float], floor: float, k: int) -> DataFrame:
    """Rows (term, text, score) of the ``k`` definitions (term, text, embedding) nearest to a question, none below ``floor``;
    ties by term and text."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = definitions.select("term", "text", cosine("embedding", q).alias("score")).where(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), "term", "text").limit(k)


def selectable(metrics: DataFrame, context: list[str], granted: list[str], closed_columns: list[str]) -> DataFrame:
    """The metrics or dimensions (name, source, columns as table.column) that may be offered: their table is in context and
    granted, and no column that they read is closed."""
    tables = sorted(set(context) & set(granted))
    if not tables:
        return metrics.limit(0)
    shut = F.exists("columns", lambda c: c.isin(*closed_columns)) if closed_columns else F.lit(False)
    return metrics.where(F.col("source").isin(*tables) & ~shut)


def starters(metrics: DataFrame, dimensions: DataFrame, k: int) -> DataFrame:
    """Questions to begin with, composed of metrics (name, source) and dimensions (name, source) of one table: the first ``k`` in
    the order of metric and dimension."""
    from ..functions.text import normalized

    both = metrics.select(F.col("name").alias("metric"), "source").join(dimensions.select(F.col("name").alias("dimension"), "source"), "source")
    asked = F.concat(F.lit("What is "), normalized("metric"), F.lit(" by "), normalized("dimension"), F.lit("?"))
    return both.select("source", "metric", "dimension", asked.alias("question")).orderBy("metric", "dimension", "source").limit(k)
