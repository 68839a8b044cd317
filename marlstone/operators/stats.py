"""Statistics over recorded answers: tallies, service levels, paired tests, splits."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


NEAR = 0.005  # share of the values on either side of a place among which a pass looks for it
FEW = 10_000  # values that are sorted on the driver


def value_at(values: DataFrame, place: int) -> float | None:
    """The value at ``place`` (from 0) of the sorted values of the one numeric column, nulls and NaN left out; None beyond the last.

    Each pass counts what lies below and between two approximate quantiles around the place and goes on with the part that
    holds it, until ``FEW`` are left or all are equal: what reaches the driver is bounded.
    """
    name = values.columns[0]
    left = values.select(F.col(name).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = left.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not 0 <= place < n:
        return None
    while low != high:
        if n <= FEW:
            return sorted(r[0] for r in left.collect())[place]
        a, b = left.agg(F.approx_percentile("v", [max(0.0, place / n - NEAR), min(1.0, place / n + NEAR)], 10_000)).first()[0]
        while True:
            below, upto = left.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
            if place < below:
                part, place_in, size = left.where(F.col("v") < a), place, below
            elif place < upto:
                part, place_in, size = left.where(F.col("v").between(a, b)), place - below, upto - below
            else:
                part, place_in, size = left.where(F.col("v") > b), place - upto, n - upto
            if size < n:
                break
            a, b = low, low + (high - low) / 2  # nothing was left out: halve the range
            if b >= high:  # neighbouring numbers
                b = low
        left, place = part, place_in
        n, low, high = left.agg(F.count("v"), F.min("v"), F.max("v")).first()
    return low


def percentile_at(values: DataFrame, q: float) -> float | None:
    """The value at place int(q * n) of the sorted values, the last at most."""
    v = F.col(values.columns[0]).cast("double")
    n = values.agg(F.count_if(v.isNotNull() & ~F.isnan(v))).first()[0]
    return value_at(values, min(int(q * n), n - 1)) if n else None


def service_levels(log: DataFrame) -> DataFrame:
    """One row over answers (deferred, failed, cached, total_ms): failing is not deferring, and not in the rate's base."""
    n, deferred, errors = F.count(F.lit(1)), F.count_if(F.col("deferred") & ~F.col("failed")), F.count_if("failed")
    return log.agg(
        n.alias("answers"), deferred.alias("deferrals"), errors.alias("errors"),
        F.coalesce(F.try_divide(deferred, n - errors), F.lit(0.0)).alias("deferral_rate"), F.coalesce(F.try_divide(F.count_if("cached"), n), F.lit(0.0)).alias("cache_hit_rate"),
        *(F.lit(percentile_at(log.select("total_ms"), q) or 0.0).alias(name) for q, name in ((0.5, "p50_ms"), (0.95, "p95_ms"))),
    )


def outcome_report(cases: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Accuracy by slice over cases (outcome, unportable): facts count, declining what can't be answered doesn't."""
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    answerable = is_("CORRECT", "CORRECT_FACTS", "WRONG", "DEFERRED_WRONGLY", "ERROR")
    exact = is_("CORRECT") - F.count_if((F.col("outcome") == "CORRECT") & F.col("unportable"))
    share = lambda a: F.coalesce(F.try_divide(a, answerable), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("cases"), answerable.alias("answerable"), share(is_("CORRECT", "CORRECT_FACTS")).alias("accuracy"), share(exact).alias("strict_accuracy")]
    return cases.groupBy(*by).agg(*aggs)


def trend(runs: DataFrame, tolerance: float) -> DataFrame:
    """Runs (run, accuracy) with the change from the one before and whether it fell by more than ``tolerance``."""
    w = Window.orderBy("run")  # as long as the list of runs
    return runs.withColumn("change", F.col("accuracy") - F.lag("accuracy").over(w)).withColumn("regressed", F.coalesce(F.col("change") < -tolerance, F.lit(False)))


def discordant(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b) over two tables (case_id, correct): cases that one side alone got right."""
    both = a.select("case_id", F.col("correct").alias("x")).join(b.select("case_id", F.col("correct").alias("y")), "case_id")
    return both.agg(F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(~F.col("x") & F.col("y")).alias("only_b"))


def sign_tail(wins: int, losses: int) -> Fraction:
    """The chance of ``wins`` or more heads in wins + losses throws of a fair coin, exact."""
    n = wins + losses
    ways = here = 1  # of n heads; then of one less, by the recurrence of binomial coefficients
    for heads in range(n, wins, -1):
        here = here * heads // (n - heads + 1)
        ways += here
    return Fraction(ways, 1 << n)


def paired_test(pairs: DataFrame) -> DataFrame:
    """Rows (name, only_a, only_b) with ``p_better`` (that a wins so often by chance) and ``p`` (two-sided), by an exact sign
    test. One row a comparison."""
    counts = pairs.select("name", "only_a", "only_b").collect()  # a list of comparisons, made by hand
    out = []
    for name, a, b in counts:
        if min(a, b) < 0:
            raise ValueError(f"{name}: a negative count")
        out.append((name, a, b, float(sign_tail(a, b)), float(min(1, 2 * sign_tail(max(a, b), min(a, b))))))
    return pairs.sparkSession.createDataFrame(out, "name string, only_a long, only_b long, p_better double, p double")


def step_down(tests: DataFrame, alpha: float) -> DataFrame:
    """Rows (name, p) with ``rank``, the ``adjusted`` p of the step-down correction (the largest, up to this rank, of p times
    the number of tests not yet passed; 1 at most) and ``passes``: it is below ``alpha``."""
    order = Window.orderBy("p", "name")  # a list of comparisons
    ranked = tests.select("name", "p", F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("m"))
    adjusted = F.least(F.lit(1.0), F.max(F.col("p") * (F.col("m") - F.col("rank") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.select("name", "p", "rank", adjusted.alias("adjusted"), (adjusted < alpha).alias("passes"))


def wins_needed(answerable: int, arms: int, alpha: float) -> int | None:
    """The fewest wins without a loss whose two-sided p, 2 ** (1 - wins), is below alpha / arms; None if there are not so many
    answerable cases."""
    if arms <= 0:
        raise ValueError("a gain needs something to compare")
    wins = max(1, 1 + math.floor(math.log2(arms / alpha)))
    while not Fraction(2, 1 << wins) < Fraction(alpha) / arms:
        wins += 1
    return wins if wins <= answerable else None


def split(cases: DataFrame, seed: int, share: str) -> DataFrame:
    """Cases (case_id, answerable) with ``part``: the first floor(share * n) of each group by a hash of seed and id are held out.

    ``share`` is read as written, as a fraction.
    """
    exact = Fraction(share)
    key = F.sha2(F.concat(F.lit(f"{seed}"), F.decode(F.unhex(F.lit("00")), "UTF-8"), F.col("case_id").cast("string")), 256)
    ranked = cases.withColumn("n", F.row_number().over(Window.partitionBy("answerable").orderBy(key))).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("answerable")))
    held = F.col("n") <= F.floor(F.col("size") * F.lit(exact.numerator) / F.lit(exact.denominator))
    return ranked.select("case_id", "answerable", F.when(held, "held_out").otherwise("tuning").alias("part"))


def verify_replay(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each threshold, wrong answers that a judge's score below it would catch and right ones it would lose."""
    both = F.broadcast(thresholds).crossJoin(scores)  # a handful of thresholds
    below = F.col("score") < F.col("threshold")
    return both.groupBy("threshold").agg(F.count_if(below & ~F.col("correct")).alias("wrong_caught"), F.count_if(below & F.col("correct")).alias("correct_lost"))
