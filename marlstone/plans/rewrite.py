"""Plans that Spark runs wrongly or in quadratic time, as equal ones that it runs well."""

from __future__ import annotations

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import range_count
from .tree import Node, analyzed

_CATALYST = "org.apache.spark.sql.catalyst"
LIMITS, NAMES = ("GlobalLimit", "LocalLimit", "Offset"), ("Project", "SubqueryAlias")


def rewritten(df: DataFrame, plan: Node | None = None) -> DataFrame:
    """The same statement with the order of its subqueries' limits kept, or with its range counted by running counts;
    ``plan``: its analyzed plan, if known."""
    plan = plan or analyzed(df)
    out = ordered_limits(df, plan)
    return range_counts(df, plan) if out is df else out


def ordered_limits(df: DataFrame, plan: Node) -> DataFrame:
    """Correlated subqueries that sort by a column they don't return keep that order under their limit.

    Spark turns the limit of a correlated subquery into row numbers per outer value, and takes their order from a sort right
    below the limit. A projection between the two (the sort's column is dropped, or an expression computed) hides it: rows
    are then numbered as they happen to arrive. The projection goes above the limit, which returns the same rows.
    """
    hidden = any(_hides(n) for top in plan.plan_nodes() for e in top.exprs for x in e.walk() for p in x.plans for n in p.plan_nodes())
    if not hidden:
        return df
    return _frame(df.sparkSession, _lifted(df.sparkSession, df._jdf.queryExecution().analyzed(), False))


def _hides(n: Node) -> bool:
    """Whether a projection stands between this limit and its sort."""
    if n.kind not in LIMITS:
        return False
    while n.kind in LIMITS and n.children:
        n = n.children[0]
    if n.kind not in NAMES:
        return False
    while n.kind in NAMES and n.children:
        n = n.children[0]
    return n.kind == "Sort"


#: What a range may be counted over: it is read twice, so no row may depend on chance.
STEADY = ("Project", "Filter", "SubqueryAlias", "View", "LogicalRelation")


def range_counts(df: DataFrame, plan: Node) -> DataFrame:
    """A statement that counts all rows in a range of time up to the current row, by running counts; any other as it is."""
    n = plan
    while n.kind in NAMES and all(e.kind == "AttributeReference" for e in n.named.get("projectList", [])) and n.children:
        n = n.children[0]
    if n.kind != "Window" or not _counts_range(n) or any(p.kind not in STEADY for p in n.children[0].plan_nodes()):
        return df
    spark, window = df.sparkSession, df._jdf.queryExecution().analyzed()
    while window.nodeName() != "Window":
        window = window.children().head()
    child = window.children().head()
    if not child.deterministic():
        return df
    ids = {a.exprId().id(): f"c{i}" for i, a in enumerate(_items(child.output()))}
    counted = window.windowExpressions().head()
    lower = counted.child().windowSpec().frameSpecification().lower().sql()
    on, by = ids[n.named["orderSpec"][0].children[0].expr_id], [ids[e.expr_id] for e in n.named.get("partitionSpec", [])]
    out = range_count(_frame(spark, child).toDF(*ids.values()), by, on, F.expr(f"{on} + {lower}"), "counted")
    ids[counted.exprId().id()] = "counted"
    return out.select(*(F.col(ids[a.exprId().id()]).alias(a.name()) for a in _items(df._jdf.queryExecution().analyzed().output())))


def _counts_range(n: Node) -> bool:
    """Whether this window is one count of all rows from an interval of days or less before the current row up to it."""
    if len(n.named["windowExpressions"]) != 1 or len(n.named.get("orderSpec", [])) != 1:
        return False
    order, whole = n.named["orderSpec"][0], n.named["windowExpressions"][0].children[0]
    by = n.named.get("partitionSpec", [])
    if whole.kind != "WindowExpression" or any(e.kind != "AttributeReference" for e in (*by, order.children[0])):
        return False
    f, frame = whole.children[0], whole.children[1].children[-1]
    ends = frame.children
    return (
        f.kind == "AggregateExpression" and [c.kind for c in f.children] == ["Count"] and not f.fields.get("isDistinct")
        and [c.kind for c in f.children[0].children] == ["Literal"] and f.children[0].children[0].fields.get("value") is not None
        and frame.kind == "SpecifiedWindowFrame" and "RangeFrame" in str(frame.fields.get("frameType")) and "Ascending" in str(order.fields.get("direction"))
        and order.children[0].fields.get("dataType") in ("timestamp", "timestamp_ntz")
        and [e.kind for e in ends] == ["UnaryMinus", "CurrentRow"] and ends[0].children[0].kind == "Literal"
        and str(ends[0].children[0].fields.get("dataType")).startswith(("interval day", "interval hour", "interval minute", "interval second"))
    )


def _frame(spark: SparkSession, plan: JavaObject) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _is(spark: SparkSession, x: object, name: str) -> bool:
    return isinstance(x, JavaObject) and is_instance_of(spark.sparkContext._gateway, x, name)


def _seq(spark: SparkSession, items: list) -> JavaObject:
    return spark._jvm.PythonUtils.toSeq(items)


def _items(seq: JavaObject) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _lifted(spark: SparkSession, plan: JavaObject, below: bool) -> JavaObject:
    """The plan with projections above limits; ``below``: within a subquery."""
    if below:
        plan = _projected_last(spark, plan)
    old = _items(plan.children())
    new = [_lifted(spark, c, below) for c in old]
    if any(a is not b for a, b in zip(old, new, strict=True)):
        plan = plan.withNewChildren(_seq(spark, new))
    args = [plan.productElement(i) for i in range(plan.productArity())] if new else []
    put = [_argument(spark, a) for a in args]
    if any(a is not b for a, b in zip(args, put, strict=True)):
        array = spark.sparkContext._gateway.new_array(spark._jvm.Object, len(put))
        for i, x in enumerate(put):
            array[i] = x
        plan = plan.makeCopy(array)
    return plan


def _projected_last(spark: SparkSession, plan: JavaObject) -> JavaObject:
    limits, names, n = [], [], plan
    while n.nodeName() in LIMITS:
        limits.append(n)
        n = n.children().head()
    while limits and n.nodeName() in NAMES:
        names.append(n)
        n = n.children().head()
    if not names or n.nodeName() != "Sort":
        return plan
    for above in (*reversed(limits), *reversed(names)):
        n = above.withNewChildren(_seq(spark, [n]))
    return n


def _argument(spark: SparkSession, x: object) -> object:
    """An argument of a plan node with the subqueries in it lifted; the same object where there is nothing to lift."""
    if _is(spark, x, f"{_CATALYST}.expressions.Expression"):
        return _expression(spark, x)
    if _is(spark, x, "scala.collection.immutable.Seq"):
        old = _items(x)
        new = [_argument(spark, a) for a in old]
        return x if all(a is b for a, b in zip(old, new, strict=True)) else _seq(spark, new)
    if _is(spark, x, "scala.Some"):
        new = _argument(spark, x.get())
        return x if new.equals(x.get()) else spark._jvm.scala.Some(new)
    return x


def _expression(spark: SparkSession, e: JavaObject) -> JavaObject:
    if _is(spark, e, f"{_CATALYST}.expressions.PlanExpression"):
        e = e.withNewPlan(_lifted(spark, e.plan(), True))
    old = _items(e.children())
    new = [_expression(spark, c) for c in old]
    return e if all(a is b for a, b in zip(old, new, strict=True)) else e.withNewChildren(_seq(spark, new))
