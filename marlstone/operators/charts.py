"""Metrics and charts as aggregations, and checks of the values that a chart shows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import GRAINS, grain as cut
from ..plans.tree import Node, analyzed

#: Chart families that are a plain aggregation (fixed values), and steps after the query, which can't be checked.
FAMILIES = ("table", "bar", "line", "area", "scatter", "pie", "donut", "big_number", "pivot", "treemap", "sunburst", "sankey", "funnel", "gauge", "radar", "heatmap", "waterfall", "histogram", "box")
POST = ("rolling", "time_compare", "resample", "contribution", "percent_metrics", "forecast", "rebase")
CHECKED, MISMATCH, EMPTY, CUT, FORMAT_WRONG = "CHECKED", "MISMATCH", "EMPTY", "CUT", "FORMAT_WRONG"


class NotCheckable(ValueError):
    """The chart's values are not those of one aggregation."""


class Incompatible(ValueError):
    """A metric can't be split by that dimension, or lies in another table."""


@dataclass(frozen=True)
class Metric:
    name: str
    expr: str
    source: str
    dimensions: frozenset[str]
    time: str | None = None
    percent: bool = False


@dataclass(frozen=True)
class Chart:
    family: str
    dimensions: list[str]
    metrics: list[Metric]
    grain: str | None = None
    where: str | None = None
    having: str | None = None
    rank: tuple[str, int] | None = None
    totals: bool = False
    post: list[str] = field(default_factory=list)


def aggregates(df: DataFrame, expr: str) -> bool | None:
    """Whether an expression aggregates rows; None if it can't be told because it doesn't resolve."""
    try:
        plan = analyzed(df.agg(F.expr(expr)))
    except Exception:  # noqa: BLE001
        return None

    def found(n: Node) -> bool:
        return n.kind == "AggregateExpression" or n.kind != "WindowExpression" and any(map(found, n.children))

    return any(found(e) for n in plan.plan_nodes() if n.kind == "Aggregate" for e in n.named.get("aggregateExpressions", []))


def columns_read(df: DataFrame, expr: str) -> set[str]:
    """The columns that an expression reads, by analysing it."""
    plan = analyzed(df.agg(F.expr(expr)))
    return {x.fields["name"] for e in plan.named.get("aggregateExpressions", []) for x in e.walk() if x.kind == "AttributeReference"}


def scales_percent(df: DataFrame, expr: str) -> bool:
    """Whether an expression multiplies by 100 or divides by 0.01: a percent is shown from a share."""
    plan = analyzed(df.agg(F.expr(expr)))
    for e in plan.named.get("aggregateExpressions", []):
        for x in e.walk():
            if x.kind in ("Multiply", "Divide"):
                values = {float(v) for c in x.children for y in c.walk() if y.kind == "Literal" and _number(v := y.fields.get("value"))}
                if (x.kind == "Multiply" and 100.0 in values) or (x.kind == "Divide" and 0.01 in values):
                    return True
    return False


def _number(v) -> bool:
    try:
        float(v)
        return True
    except (TypeError, ValueError):
        return False


def measure(df: DataFrame, metrics: list[Metric], dimensions: list[str], *, grain: str | None = None, where: str | None = None, having: str | None = None, totals: bool = False) -> DataFrame:
    """Metrics by dimensions, and by the metrics' time at a grain. With ``totals``, subtotals over all dimensions, each
    marked by a column __total_<dimension>."""
    if len({m.source for m in metrics}) > 1:
        raise Incompatible("metrics of several tables: combine their results")
    for m in metrics:
        bad = set(dimensions) - m.dimensions
        if bad:
            raise Incompatible(f"{m.name} can't be split by {', '.join(sorted(bad))}")
        if m.percent and scales_percent(df, m.expr):
            raise Incompatible(f"{m.name} is a percent and scales by 100")
    keys = [F.col(f"`{d}`") for d in dimensions]
    if grain:
        time = metrics[0].time
        if grain not in GRAINS or time is None:
            raise Incompatible(f"no grain {grain} of {metrics[0].name}")
        keys.append(cut(grain, time).alias(time))
    rows = df.where(where) if where else df
    aggs = [F.expr(m.expr).alias(m.name) for m in metrics]
    if totals:
        out = rows.cube(*keys).agg(*aggs, *(F.grouping(d).cast("long").alias(f"__total_{d}") for d in dimensions))
    else:
        out = rows.groupBy(*keys).agg(*aggs)
    return out.where(having) if having else out


def compile_chart(df: DataFrame, chart: Chart) -> DataFrame:
    """The rows that a chart shows. A ranked limit keeps ties at the cut, so that the result is one and the same."""
    if chart.family not in FAMILIES:
        raise NotCheckable(f"chart family {chart.family}")
    if chart.post:
        raise NotCheckable(f"computed after the query: {', '.join(chart.post)}")
    out = measure(df, chart.metrics, chart.dimensions, grain=chart.grain, where=chart.where, having=chart.having, totals=chart.totals)
    if chart.rank:
        metric, n = chart.rank
        # the n-th value, by a bounded sort; no global window
        last = out.where(F.col(metric).isNotNull()).select(metric).orderBy(F.desc_nulls_last(metric)).limit(n).agg(F.min(metric).alias("__last"))
        out = out.join(F.broadcast(last), F.col(metric) >= F.col("__last")).drop("__last")
    return out


def check_values(shown: DataFrame, own: DataFrame, keys: list[str], percents: list[str] = [], cap: int | None = None) -> str:  # noqa: B006
    """Compare a chart's rows with our own by group: integers exactly, floats to a part in 10^12, null keys alike."""
    values = [c for c in own.columns if c not in keys]
    if own.isEmpty() and shown.isEmpty():
        return EMPTY
    for p in percents:
        if not own.where(F.abs(p) > 1 + 1e-9).isEmpty():
            return FORMAT_WRONG
    b = own.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(v).alias(f"__{v}") for v in values), F.lit(1).alias("__own"))
    a = shown.withColumn("__shown", F.lit(1))
    same = F.lit(True)
    for k in keys:
        same = same & a[k].eqNullSafe(b[f"__{k}"])
    differ = F.col("__own").isNull() | F.col("__shown").isNull()
    for v in values:
        kind = own.schema[v].dataType.typeName()
        near = F.abs(F.col(v) - F.col(f"__{v}")) <= 1e-12 * F.greatest(F.abs(F.col(v)), F.abs(F.col(f"__{v}"))) if kind in ("double", "float") else F.lit(False)
        differ = differ | ~(F.col(v).eqNullSafe(F.col(f"__{v}")) | F.coalesce(near, F.lit(False)))
    wrong = not a.join(b, same, "full").where(differ).isEmpty()
    if wrong:
        return MISMATCH
    return CUT if cap and shown.count() >= cap else CHECKED


#: Aggregates that a chart's form may name, and how they are spelt here (fixed values).
FORM_AGGREGATES = {"SUM": "sum({})", "AVG": "avg({})", "MIN": "min({})", "MAX": "max({})", "COUNT": "count({})", "COUNT_DISTINCT": "count(distinct {})"}
FORM_GRAINS = {"P1D": "day", "P1W": "week", "P1M": "month", "P3M": "quarter", "P1Y": "year"}
FORM_OPERATORS = {"==": "=", "!=": "<>", ">": ">", "<": "<", ">=": ">=", "<=": "<=", "IN": "in", "NOT IN": "not in"}


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _literal(v) -> str:
    return repr(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_form(form: dict, source: str, time: str | None = None) -> Chart:
    """The chart that a form describes: dimensions, metrics, filters, grain and ranked limit. What the form computes after its
    query, or states in a way that isn't known here, makes it ``NotCheckable`` with the reason."""
    for key in ("rolling_type", "time_compare", "resample_rule", "forecastEnabled", "post_processing"):
        if form.get(key) and form[key] != "None":
            raise NotCheckable(f"computed after the query: {key}")
    metrics = []
    dimensions = [*form.get("groupby", []), *(c for c in form.get("columns", []) if c not in form.get("groupby", []))]
    for m in form.get("metrics") or ([form["metric"]] if form.get("metric") else []):
        if m == "count":
            metrics.append(Metric("count", "count(1)", source, frozenset(dimensions), time))
        elif isinstance(m, dict) and m.get("expressionType") == "SIMPLE" and m.get("aggregate") in FORM_AGGREGATES:
            metrics.append(Metric(m.get("label") or f"{m['aggregate']}({m['column']})", FORM_AGGREGATES[m["aggregate"]].format(_quoted(m["column"])), source, frozenset(dimensions), time))
        elif isinstance(m, dict) and m.get("expressionType") == "SQL":
            metrics.append(Metric(m["label"], m["sqlExpression"], source, frozenset(dimensions), time))
        else:
            raise NotCheckable(f"metric {m!r}")
    if not metrics:
        raise NotCheckable("no metric")
    wheres, havings = [], []
    for f in form.get("adhoc_filters", []):
        if f.get("expressionType") == "SQL":
            text = f["sqlExpression"]
        elif f.get("operator") in FORM_OPERATORS:
            v = f["comparator"]
            value = f"({', '.join(map(_literal, v))})" if isinstance(v, list) else _literal(v)
            text = f"{_quoted(f['subject'])} {FORM_OPERATORS[f['operator']]} {value}"
        else:
            raise NotCheckable(f"filter {f.get('operator')!r}")
        (havings if f.get("clause") == "HAVING" else wheres).append(f"({text})")
    grain = form.get("time_grain_sqla")
    if grain and grain not in FORM_GRAINS:
        raise NotCheckable(f"grain {grain!r}")
    limit = form.get("row_limit")
    return Chart(
        form.get("viz_type", "table"), dimensions, metrics, FORM_GRAINS.get(grain) if grain else None, " and ".join(wheres) or None, " and ".join(havings) or None,
        (metrics[0].name, int(limit)) if limit and form.get("order_desc", True) else None,
    )


def literal_probes(df: DataFrame, compared: list[tuple[str, object]]) -> DataFrame:
    """Rows (column, value, held): whether any row that may be read holds a value that a filter compares with; None asks for
    missing values. One pass over the table."""
    asked = [(f"p{i}", c, v) for i, (c, v) in enumerate(compared)]
    same = lambda c, v: F.col(_quoted(c)).isNull() if v is None else F.col(_quoted(c)) == F.lit(v)
    got = df.agg(*(F.coalesce(F.bool_or(same(c, v)), F.lit(False)).alias(p) for p, c, v in asked)).first()
    return df.sparkSession.createDataFrame([(c, None if v is None else str(v), got[p]) for p, c, v in asked], "column string, value string, held boolean")
