"""What codes mean: from a sibling column, from a lookup table, from a code scheme, in order of precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import affinity, is_label
from .profile import is_functional

#: Weakest first.
SOURCES = ("ontology", "correlated", "lookup", "dictionary")
#: Values that say nothing about a scheme, and the gates of a binding (fixed values).
SENTINELS = ("", "n/a", "na", "unknown", "null", "none", "-1", "?")
CONTAINMENT, AFFINITY, LEAST_MATCHED = 0.95, 0.50, 4
NEAR_CONTAINMENT, NEAR_AFFINITY = 0.80, 0.40
MOST_LOOKUP = 25


def correlated(df: DataFrame, code: str) -> DataFrame:
    """Rows (code, meaning) from the only label-like sibling that the code determines; none if there are two or none."""
    labels = [c for c in df.columns if c != code and is_label(c) and is_functional(df, code, c).first()["holds"]]
    if len(labels) != 1:
        return df.sparkSession.createDataFrame([], "code string, meaning string")
    return df.where(F.col(code).isNotNull()).select(F.col(code).cast("string").alias("code"), F.col(labels[0]).cast("string").alias("meaning")).where("meaning is not null").distinct()


def lookup(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, most: int = MOST_LOOKUP) -> DataFrame:
    """Rows (code, meaning) of the child's codes by the parent's only label column; none if the codes are many."""
    labels = [c for c in parent.columns if c != parent_col and is_label(c)]
    codes = child.where(F.col(child_col).isNotNull()).select(F.col(child_col).alias("k")).distinct()
    if len(labels) != 1 or codes.count() > most:
        return child.sparkSession.createDataFrame([], "code string, meaning string")
    named = parent.select(F.col(parent_col).alias("k"), F.col(labels[0]).cast("string").alias("meaning"))
    return codes.join(named, "k").select(F.col("k").cast("string").alias("code"), "meaning").distinct()


def by_precedence(meanings: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Of rows (keys, meaning, source), for each key that of the strongest source, ties by meaning."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    w = Window.partitionBy(*keys).orderBy(F.desc(rank), "meaning")
    return meanings.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def scheme_scores(values: DataFrame, schemes: DataFrame) -> DataFrame:
    """Rows (column, scheme_id, matched, considered, containment, affinity).

    ``values``: (column, value); ``schemes``: (scheme_id, label, notation). Sentinels count neither way.
    """
    clean = values.select("column", F.lower(F.trim("value")).alias("v"), "value").distinct()
    pairs = clean.select("column").distinct().join(F.broadcast(schemes.select("scheme_id", "label").distinct()))  # columns x schemes: the catalogue's size
    notations = schemes.select("scheme_id", F.lower(F.trim("notation")).alias("v"), F.lit(True).alias("hit")).distinct()
    each = pairs.join(clean, "column").join(notations, ["scheme_id", "v"], "left").where(F.col("hit") | ~F.col("v").isin(*SENTINELS))
    scored = each.groupBy("column", "scheme_id", "label").agg(F.count_if("hit").alias("matched"), F.count(F.lit(1)).alias("considered"))
    return scored.select("column", "scheme_id", "matched", "considered", (F.col("matched") / F.col("considered")).alias("containment"), affinity("column", "label").alias("affinity"))


def bind(scores: DataFrame) -> DataFrame:
    """Bindings (column, scheme_id): columns that exactly one scheme passes all gates for."""
    passed = scores.where((F.col("matched") >= LEAST_MATCHED) & (F.col("containment") >= CONTAINMENT) & (F.col("affinity") >= AFFINITY))
    return passed.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("scheme_id").alias("scheme_id")).where("n = 1").drop("n")


def suggestions(scores: DataFrame) -> DataFrame:
    """Near misses (column, scheme_id, why) of columns that are not bound: below a gate, or several schemes passing."""
    bound = bind(scores)
    near = scores.join(bound.select("column"), "column", "left_anti").where((F.col("matched") >= LEAST_MATCHED) & (F.col("containment") >= NEAR_CONTAINMENT) & (F.col("affinity") >= NEAR_AFFINITY))
    strict = (F.col("containment") >= CONTAINMENT) & (F.col("affinity") >= AFFINITY)
    return near.select("column", "scheme_id", F.when(strict, "ambiguous").when(F.col("containment") < CONTAINMENT, "containment").otherwise("affinity").alias("why"))


#: Properties of a vocabulary's concepts, by the last part of their names (fixed values).
NOTATION, LABEL, ALSO, SCHEME = "notation", "prefLabel", "altLabel", "inScheme"


def read_triples(spark, path: str) -> DataFrame:
    """Rows (subject, predicate, object) of a file of N-Triples: the predicate's last part, literals without quotes and tags."""
    m = r'^\s*<([^>]*)>\s+<[^>]*[/#]([^>/#]+)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    part = lambda i: F.regexp_extract("value", m, i)
    rows = spark.read.text(path).where(F.col("value").rlike(m))
    return rows.select(part(1).alias("subject"), part(2).alias("predicate"), F.when(part(3) != "", part(3)).otherwise(F.regexp_replace(part(4), r"\\(.)", "$1")).alias("object"))


def digest(triples: DataFrame) -> DataFrame:
    """Rows (scheme_id, scheme_label, notation, label, also) of the concepts that lie in a scheme and have a notation: ``also``, the
    other labels in order. A scheme without a label is named by its id's last part."""
    of = lambda p: F.col("predicate") == p
    concepts = triples.groupBy("subject").agg(
        F.max(F.when(of(SCHEME), F.col("object"))).alias("scheme_id"), F.min(F.when(of(NOTATION), F.col("object"))).alias("notation"),
        F.min(F.when(of(LABEL), F.col("object"))).alias("label"), F.array_sort(F.collect_set(F.when(of(ALSO), F.col("object")))).alias("also"),
    )
    named = concepts.select(F.col("subject").alias("scheme_id"), F.col("label").alias("scheme_label"))
    held = concepts.where("scheme_id is not null and notation is not null").join(named, "scheme_id", "left")
    return held.select("scheme_id", F.coalesce("scheme_label", F.regexp_extract("scheme_id", "([^/#]+)$", 1)).alias("scheme_label"), "notation", "label", "also")
