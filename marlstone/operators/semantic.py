"""Meaning laid over metadata: certified descriptions, definitions, concepts, saved metrics, repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized, similarity

CONCEPT_FLOOR, MOST_CONCEPTS = 0.25, 15


def overlay(columns: DataFrame, certified: DataFrame) -> DataFrame:
    """Columns (table, column, description, levels) with certified descriptions in place of found ones; levels unite, none is dropped."""
    c = certified.select("table", "column", F.col("description").alias("__d"), F.col("levels").alias("__l"))
    both = columns.join(c, ["table", "column"], "left")
    none = F.array().cast("array<string>")
    levels = F.sort_array(F.array_union(F.coalesce("levels", none), F.coalesce("__l", none)))
    return both.select("table", "column", F.coalesce("__d", "description").alias("description"), levels.alias("levels"))


def stale_codes(definitions: DataFrame, index: DataFrame) -> DataFrame:
    """Definitions (term, table, column, text) that name codes in quotes of which their indexed column holds none."""
    quoted = definitions.select("term", "table", "column", F.regexp_extract_all("text", F.lit("'([^']+)'"), F.lit(1)).alias("codes")).where(F.size("codes") > 0)
    known = quoted.join(index.select("table", "column").distinct(), ["table", "column"], "left_semi")
    held = known.select("term", "table", "column", F.explode("codes").alias("value")).join(index, ["table", "column", "value"], "left_semi").select("term").distinct()
    return known.join(held, "term", "left_anti").select("term", "table", "column", "codes")


def definitions_for(definitions: DataFrame, granted: list[str], context: list[str], question: str) -> DataFrame:
    """Definitions (term, public, tables) that may be shown, and that ride with a table in context or are named in the question."""
    allowed = F.col("public") | (F.forall("tables", lambda t: t.isin(*granted)) & (F.size("tables") > 0)) if granted else F.col("public")
    asked = F.concat(F.lit(" "), normalized(F.lit(question)), F.lit(" "))
    named = F.contains(asked, F.concat(F.lit(" "), normalized("term"), F.lit(" ")))
    rides = F.exists("tables", lambda t: t.isin(*context)) if context else F.lit(False)
    return definitions.where(allowed & (named | rides))


def resolve_concepts(concepts: DataFrame, bound: DataFrame, phrase: str, floor: float = CONCEPT_FLOOR, most: int = MOST_CONCEPTS) -> DataFrame:
    """Codes of the schemes bound to columns (column, scheme_id) whose best label is like ``phrase``: column, notation, label,
    score. ``concepts``: scheme_id, notation, label, one row per label."""
    scored = concepts.join(bound, "scheme_id").withColumn("score", similarity("label", F.lit(phrase))).where(F.col("score") >= floor)
    best = scored.groupBy("column", "notation").agg(F.max_by(F.struct("label", "score"), F.struct("score", "label")).alias("b"))
    return best.select("column", "notation", "b.label", "b.score").orderBy(F.desc("score"), "column", "notation").limit(most)


def same_measure(df: DataFrame, a: str, b: str) -> bool:
    """Whether two expressions are one measure, however they are spelt."""
    one = lambda e: df.agg(F.expr(e).alias("m"))
    return one(a).sameSemantics(one(b))


def reuse(df: DataFrame, expr: str, saved: list[tuple[str, str, bool]]) -> str | None:
    """The saved metric (name, expression, certified) that already is this measure; certified ones first, then by name."""
    return next((n for n, e, _ in sorted(saved, key=lambda s: (not s[2], s[0])) if same_measure(df, expr, e)), None)


def run_stability(runs: DataFrame) -> DataFrame:
    """Of rows (case_id, run, outcome), one per case: runs, the outcome most often seen (ties by name), its share."""
    per = runs.groupBy("case_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("case_id")
    ranked = per.withColumn("runs", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "outcome")))
    return ranked.where("r = 1").select("case_id", "runs", "outcome", (F.col("n") / F.col("runs")).alias("share"))


def last_attempts(attempts: DataFrame) -> DataFrame:
    """Of rows (case_id, attempt, ...), the last attempt of each case."""
    rest = [c for c in attempts.columns if c != "case_id"]
    return attempts.groupBy("case_id").agg(F.max_by(F.struct(*rest), "attempt").alias("x")).select("case_id", *(f"x.{c}" for c in rest))
