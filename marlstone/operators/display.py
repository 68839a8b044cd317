"""How values are shown: number formats, and results cut to a page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL, COLUMNS, ROWS = 240, 50, 20
_FORMAT = re.compile(r"([$]?)(,?)(?:\.(\d+))?([f%d])")


def shown(value: Column | str, fmt: str) -> Column:
    """A number in one of the formats ``[$][,][.places](f|%|d)``: a currency sign, thousands apart, places, fixed, percent or
    whole. Null stays null; another format is refused."""
    m = _FORMAT.fullmatch(fmt)
    if not m:
        raise ValueError(f"format {fmt!r}")
    sign, comma, places, kind = m.groups()
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    n = 0 if kind == "d" else int(places or 0 if kind == "%" or places else 6)
    scaled = F.round((c * 100 if kind == "%" else c).cast("decimal(38,12)"), n)
    body = F.format_number(F.abs(scaled), n)
    body = body if comma else F.replace(body, F.lit(","), F.lit(""))
    negative = scaled < 0
    return F.when(c.isNotNull(), F.concat(F.when(negative, "-").otherwise(""), F.lit(sign), body, F.lit("%" if kind == "%" else "")))


def page(df: DataFrame, rows: int = ROWS, cell: int = CELL, columns: int = COLUMNS) -> tuple[list[str], list[tuple], str]:
    """(names, rows, note) of a result as text, for a reader or a prompt: no more than so many rows, columns and characters a
    cell, and a note that says what was left out."""
    kept = df.columns[:columns]
    some = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in kept)).limit(rows + 1)
    cut = some.select(*(F.when(F.length(f"`{c}`") > cell, F.concat(F.substring(f"`{c}`", 1, cell), F.lit("…"))).otherwise(F.col(f"`{c}`")).alias(c) for c in kept))
    got = [tuple(r) for r in cut.collect()]
    left = []
    if len(got) > rows:
        left.append(f"only the first {rows} rows")
    if len(df.columns) > columns:
        left.append(f"{len(df.columns) - columns} columns left out")
    if any(x is not None and len(x) > cell for r in got[:rows] for x in r):
        left.append(f"cells cut at {cell} characters")
    return kept, got[:rows], "; ".join(left)
