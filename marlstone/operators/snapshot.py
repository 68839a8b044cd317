"""A source described from end to end: schema, profiles, keys, views; what failed on the way; examples that hold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..plans.decide import Refused, decide
from ..plans.policy import Secured
from ..plans.tree import analyzed, view_name
from ..sources import catalog
from . import keys, profile


def build(spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(parts, jobs) of a source: ``parts`` has ``columns``, ``profiles`` and ``relationships``; ``jobs`` has a row (job, table,
    state, reason) for everything that was tried. A table that can't be opened or profiled is left out and named; the others
    go on."""
    jobs: list[tuple[str, str, str, str | None]] = []
    tables: dict[str, DataFrame] = {}
    profiles: list[DataFrame] = []

    def attempt(job: str, table: str, run: Callable):
        try:
            out = run()
            jobs.append((job, table, "done", None))
            return out
        except Exception as e:  # noqa: BLE001
            jobs.append((job, table, "failed", str(e).splitlines()[0][:200]))
            return None

    for name, load in sorted(loaders.items()):
        df = attempt("open", name, load)
        if df is not None:
            tables[name] = df
    for name, df in tables.items():
        one = attempt("profile", name, lambda df=df, name=name: profile.profile_all({name: df}))
        if one is not None:
            profiles.append(one)
    parts: dict[str, DataFrame] = {}
    if tables:
        parts["columns"] = catalog.introspect(tables)
    if profiles:
        parts["profiles"] = profiles[0]
        for p in profiles[1:]:
            parts["profiles"] = parts["profiles"].unionByName(p)
    found = attempt("joins", "*", lambda: keys.infer_by_containment(tables)) if tables else None
    parts["relationships"] = spark.createDataFrame(found or [], "child string, column string, parent string, parent_column string")
    return parts, spark.createDataFrame(jobs, "job string, table string, state string, reason string")


def describes(jobs: DataFrame) -> str:
    """Whether a snapshot describes its source: ``whole``, ``in part`` (named tables are missing) or ``not at all``."""
    opened = jobs.where("job = 'open'").groupBy("state").count().collect()
    n = {r["state"]: r["count"] for r in opened}
    if not n.get("done"):
        return "not at all"
    return "in part" if jobs.where("state = 'failed'").count() else "whole"


def views(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """Rows (view, body, tables) of the views among ``names``: the text that defines each, null where it was made by the API, and
    the tables that its plan reads."""
    rows = []
    for name in sorted(names):
        plan = analyzed(spark.table(name))
        top = next((n for n in plan.plan_nodes() if n.kind == "View"), None)
        if top is None:
            continue
        body = (top.fields.get("desc") or {}).get("viewText")
        inner = sorted({view_name(n) for c in top.children for n in c.plan_nodes() if n.kind == "View"})
        rows.append((name, body, inner))
    return spark.createDataFrame(rows, "view string, body string, tables array<string>")


def verified_examples(secured: Secured, candidates: Iterable[tuple[str, str]], most: int = 3, **options) -> list[tuple[str, str, tuple[str, ...]]]:
    """Of candidates (question, sql), in order, those that are approved, run and return rows: (question, sql, tables). No more
    than ``most`` for any table."""
    kept: list[tuple[str, str, tuple[str, ...]]] = []
    used: dict[str, int] = {}
    for question, sql in candidates:
        try:
            ruled = decide(secured, sql, **options)
            if any(used.get(t, 0) >= most for t in ruled.tables) or ruled.df.isEmpty():
                continue
        except Refused:
            continue
        except Exception:  # noqa: BLE001 - a statement that fails when it runs is no example
            continue
        kept.append((question, sql, ruled.tables))
        for t in ruled.tables:
            used[t] = used.get(t, 0) + 1
    return kept


def locatable(columns: DataFrame, granted: list[str], levels: Mapping[tuple[str, str], frozenset[str]] = {}, computed: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:  # noqa: B006
    """The columns (table, column, ...) that a hint may name: of granted tables, open to be read, held as they are."""
    from pyspark.sql import functions as F

    closed = sorted({*computed, *(k for k, v in levels.items() if v)})
    named = F.concat_ws("\x00", "table", "column")
    return columns.where(F.col("table").isin(*granted) & ~named.isin(*(f"{t}\x00{c}" for t, c in closed) or [""])) if granted else columns.limit(0)
