"""Checks of an answer before it is given, and the outcome of a case."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .results import Undecided, equal, facts_equal, sanity

#: What a question says literally: phrases in quotes, and years.
PHRASE, YEAR = r"'([^']+)'|\"([^\"]+)\"", r"\b((?:19|20)[0-9]{2})\b"


def salient(question: Column | str) -> Column:
    """The phrases in quotes and the years of a question, in lower case, each once."""
    q = F.col(question) if isinstance(question, str) else question
    phrases = F.filter(F.concat(*(F.regexp_extract_all(q, F.lit(PHRASE), F.lit(i)) for i in (1, 2))), lambda x: x != "")
    return F.array_distinct(F.transform(F.concat(phrases, F.regexp_extract_all(q, F.lit(YEAR), F.lit(1))), F.lower))


def unsaid(question: Column | str, sql: Column | str) -> Column:
    """What a question says literally that its statement nowhere holds."""
    s = F.lower(F.col(sql) if isinstance(sql, str) else sql)
    return F.filter(salient(question), lambda x: ~F.contains(s, x))


@dataclass(frozen=True)
class Verdict:
    passed: bool
    stage: str
    reason: str = ""


def verify(df: DataFrame, question: str, sql: str, judge: Callable[[str, str, DataFrame], tuple[bool, str]] | None = None) -> Verdict:
    """Sanity, then grounding, then a judge if there is one: the first that objects decides, and later ones aren't asked."""
    wrong = sanity(df)
    if wrong:
        return Verdict(False, "sanity", wrong)
    left = df.sparkSession.range(1).select(unsaid(F.lit(question), F.lit(sql)).alias("x")).first()["x"]
    if left:
        return Verdict(False, "grounding", f"not in the statement: {', '.join(left)}")
    if judge is not None:
        fine, reason = judge(question, sql, df)
        return Verdict(fine, "judge", "" if fine else reason)
    return Verdict(True, "grounding")


def outcome(answerable: bool, got: DataFrame | None, gold: DataFrame | None, most: int = 1000) -> str:
    """The outcome of one case: ``got`` None means that the answer was withheld. Results of more than ``most`` rows are only
    compared strictly."""
    if got is None:
        return "DEFERRED_WRONGLY" if answerable else "DEFERRED_CORRECTLY"
    if not answerable:
        return "WRONG"
    try:
        if equal(gold, got):
            return "CORRECT"
        few = [df.limit(most + 1).collect() for df in (gold, got)]
        if all(len(rows) <= most for rows in few) and facts_equal(*([tuple(r) for r in rows] for rows in few)):
            return "CORRECT_FACTS"
    except Undecided:
        return "UNDECIDED"
    return "WRONG"
