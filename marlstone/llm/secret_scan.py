"""Secret scans over a trigram inverted index, in Spark's own functions only.

Each rule is a regular expression. From it a Boolean trigram query is derived: the alternatives of the expression, each
with the trigrams that any match of it must hold. Postings (trigram, document) are made for the trigrams that occur in
some query, intersected per alternative, and united per rule; only the documents left are matched against the rule. A
rule with an alternative that has no mandatory trigram is matched against every document. The index decides what is
read closely, never what is found: the spans are those that the rules find in every whole text.

Postings are rows, so a trigram that every document holds is spread like any other; the documents meet their candidate
rules in one join by id.

Defined results: null text is empty text; a null id is an id like others; rows that repeat an id are each scanned; an
existing ``spans`` column is replaced; other columns stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as k
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and non-overlapping; those whose ``group`` has under ``least`` code points are dropped."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


# of a private key: the headers of an encrypted one; then all to the END line or, without one, the base64 that follows, if
# that begins with 40 characters in a row. Breaks may be written as \n; no group is repeated, which Java would do on its stack
_HEAD = r"([\\rn\x09\x0A\x0D\x20]*Proc-Type:[^-]*DEK-Info: *[A-Z0-9-]+,[0-9A-Fa-f]+)?"
_BODY = r"([^-]*-----END [A-Z ]*PRIVATE KEY-----|[\x09\x0A\x0D\x20]*[\\A-Za-z0-9+/=]{40,}[\\A-Za-z0-9+/=\x09\x0A\x0D\x20]*)?"

#: Fixed values. The first three are the base rules; kinds are listed in this order wherever spans tie.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----{_HEAD}{_BODY}"),
)
SPANS = "array<struct<kind:string,start:int,end:int>>"
MASK = "[REDACTED]"
_MOST = 64  # alternatives kept apart; beyond, a part of the expression counts as unknown, which only widens the query


def _alternatives(parsed) -> list[tuple]:
    """Every alternative as a tuple of characters and None, which stands for any string."""
    out: list[tuple] = [()]
    for op, arg in parsed:
        if op is k.LITERAL:
            ways = [(chr(arg).lower(),)]
        elif op is k.IN and all(o is k.LITERAL for o, _ in arg) and len(arg) <= 8:
            ways = sorted({(chr(a).lower(),) for _, a in arg})
        elif op is k.SUBPATTERN:
            ways = _alternatives(arg[-1])
        elif op is k.BRANCH:
            ways = [x for part in arg[1] for x in _alternatives(part)]
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
            low, high, sub = arg
            inner = _alternatives(sub)
            ways = [(), *inner] if (low, high) == (0, 1) else [(None,)] if low == 0 or low > 4 else [sum(p, ()) + ((None,) if high != low else ()) for p in reduce(lambda a, _: [x + (y,) for x in a for y in inner], range(low), [()])]
        elif op is k.AT:
            ways = [()]
        else:
            ways = [(None,)]
        if len(out) * len(ways) > _MOST:
            ways = [(None,)]
        out = [x + y for x in out for y in ways]
    return out


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The query as alternatives of trigrams that must all occur in the lower-cased text, or None: scan fully."""
    clauses = set()
    for way in _alternatives(parser.parse(regex)):
        runs = "".join(c or "\0" for c in way).split("\0")
        clauses.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _clauses(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame | None:
    """One row per rule, alternative and trigram: as long as the rules, whatever the corpus."""
    rows = [(r.kind, n, g, len(c)) for r in rules for n, c in enumerate(trigram_query(r.regex) or []) for g in sorted(c)]
    if not rows:
        return None
    each = F.array(*(F.struct(F.lit(a).alias("__rule"), F.lit(b).alias("__clause"), F.lit(g).alias("__gram"), F.lit(n).alias("__need")) for a, b, g, n in rows))
    return spark.range(1).select(F.inline(each))


def postings(docs: DataFrame, id_col: str, text_col: str, grams: list[str]) -> DataFrame:
    """The inverted index for ``grams``: rows (``__gram``, ``__sid``)."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = docs.select(F.col(id_col).alias("__sid"), low.alias("__low")).select("__sid", F.array_compact(F.array(*(F.when(F.contains("__low", F.lit(g)), F.lit(g)) for g in grams))).alias("__g"))
    # outer: for a plain explode, Spark would test the array's size below, computing each of its parts twice
    return held.select("__sid", F.explode_outer("__g").alias("__gram")).where("__gram is not null")


def candidates(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame | None:
    """Rows (``__sid``, ``__rules``): the indexed rules that may match a document; None if no rule can use the index."""
    clauses = _clauses(docs.sparkSession, rules)
    if clauses is None:
        return None
    grams = sorted({g for r in rules for c in trigram_query(r.regex) or [] for g in c})
    each = postings(docs, id_col, text_col, grams).join(F.broadcast(clauses), "__gram")
    whole = each.groupBy("__sid", "__rule", "__clause", "__need").agg(F.collect_set("__gram").alias("__g")).where(F.size("__g") == F.col("__need"))
    return whole.groupBy("__sid").agg(F.collect_set("__rule").alias("__rules"))


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points: the pieces between matches and the matches, summed up from the left."""
    regex = F.lit(rule.java)
    none = F.expr(f"cast(array() as {SPANS})")
    found = F.arrays_zip(
        F.transform(F.split(text, rule.java, -1), lambda p: F.length(p)).alias("gap"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.length(m)).alias("size"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda m: F.length(m)).alias("part"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"))
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end), code points, end exclusive, by start, then kind as listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    few = candidates(docs, id_col, text_col, rules)
    both = docs.withColumn("__rules", F.lit(None).cast("array<string>")) if few is None else docs.join(few, docs[id_col].eqNullSafe(few["__sid"]), "left").drop("__sid")
    none = F.expr(f"cast(array() as {SPANS})")

    def of(rule: Rule) -> Column:
        indexed = trigram_query(rule.regex) is not None
        if indexed:
            return F.when(F.array_contains("__rules", rule.kind), _spans(text, rule)).otherwise(none)
        quick = rf"[0-9a-f]{{{rule.least}}}" if rule.regex == "[0-9a-f]+" else rule.java  # a long enough run, or any match
        return F.when(text.rlike(quick), _spans(text, rule)).otherwise(none)

    place = {r.kind: n for n, r in enumerate(rules)}
    rank = F.create_map(*(F.lit(x) for kind, n in place.items() for x in (kind, n)))
    every = F.transform(F.concat(*(of(r) for r in rules)), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return both.withColumn("spans", ordered).drop("__rules")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every maximal run of overlapping spans replaced by ``mask``; null stays null."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.when(fresh, F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
