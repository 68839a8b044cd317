"""Time grains, and bare days compared with timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def grain(unit: str, ts: Column | str) -> Column:
    """``ts`` cut to a grain, weeks beginning on Monday, as a timestamp without zone."""
    if unit not in GRAINS:
        raise ValueError(f"grain {unit!r}; one of {', '.join(GRAINS)}")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def close_day(ts: Column, op: str, *days: str) -> Column:
    """A comparison of a timestamp with bare days read by whole days, as if ``ts`` were a date.

    Written as ranges over ``ts``, so that it reaches the scan. ``op``: = <> < <= > >= in, not in, between, not between,
    is distinct from, is not distinct from. Null compares as in the form that was written.
    """
    day = [F.lit(d).cast("date") for d in days]
    at = lambda d: d.cast("timestamp_ntz")
    after = lambda d: F.date_add(d, 1).cast("timestamp_ntz")
    within = lambda d: (ts >= at(d)) & (ts < after(d))
    if op in ("in", "not in"):
        found = within(day[0])
        for d in day[1:]:
            found = found | within(d)
        return ~found if op == "not in" else found
    if op in ("between", "not between"):
        found = (ts >= at(day[0])) & (ts < after(day[1]))
        return ~found if op == "not between" else found
    if op in ("is distinct from", "is not distinct from"):
        same = ts.isNotNull() & within(day[0])
        return ~same if op == "is distinct from" else same
    forms = {
        "=": lambda d: within(d), "<>": lambda d: ~within(d), "<": lambda d: ts < at(d), ">=": lambda d: ts >= at(d),
        "<=": lambda d: ts < after(d), ">": lambda d: ts >= after(d),
    }
    if op not in forms:
        raise ValueError(f"operator {op!r}")
    return forms[op](day[0])
