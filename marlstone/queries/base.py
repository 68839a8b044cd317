"""How queries are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.rewrite import rewritten
from ..session import read


class Registry:
    """Queries and oracle SQL of one module."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def sql(self, name: str, text: str, duck: str | None = None) -> None:
        """One statement for both engines, tables in braces; ``duck`` where DuckDB spells it differently."""
        tables = sorted(set(re.findall(r"\{(\w+)\}", text)))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rewritten(spark.sql(text, **{t: read(spark, sf_dir, t) for t in tables}))

        self.queries[name] = run
        self.text[name] = re.sub(r"\{(\w+)\}", r"\1", text)
        self.oracle[name] = re.sub(r"\{(\w+)\}", r"\1", duck or text)

    def df(self, oracle: str | None):
        """Register a function of (spark, sf_dir) under its own name."""

        def keep(f):
            self.queries[f.__name__] = f
            if oracle:
                self.oracle[f.__name__] = oracle
            return f

        return keep
