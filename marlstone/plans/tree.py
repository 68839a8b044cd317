"""Catalyst's logical plans as Python trees. The only module that touches Spark's private side."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Node:
    """A plan node or expression: the class's short name, its plain fields, its children, and the expressions it holds.

    ``plans``: plans inside expressions (subqueries), which a walk over children alone would miss. ``ctes``: as parsed, the
    bodies of a WITH by lower-case name.
    """

    kind: str
    fields: dict
    children: list[Node] = field(default_factory=list)
    exprs: list[Node] = field(default_factory=list)
    named: dict[str, list[Node]] = field(default_factory=dict)
    plans: list[Node] = field(default_factory=list)
    ctes: dict[str, Node] = field(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        """This node, what is below it, and all of its expressions and their plans."""
        yield self
        for group in (self.children, self.exprs, self.plans, self.ctes.values()):
            for n in group:
                yield from n.walk()

    def plan_nodes(self) -> Iterator[Node]:
        """Plan nodes only, subqueries' plans included."""
        yield self
        for e in self.exprs:
            for x in e.walk():
                for p in x.plans:
                    yield from p.plan_nodes()
        for c in (*self.children, *self.ctes.values()):
            yield from c.plan_nodes()

    @property
    def expr_id(self) -> int | None:
        e = self.fields.get("exprId")
        return e.get("id") if isinstance(e, dict) else None


def _node(flat: list[dict], at: int) -> tuple[Node, int]:
    raw = flat[at]
    node = Node(raw["class"].rsplit(".", 1)[-1].rstrip("$"), {})
    for key, value in raw.items():
        if key in ("class", "num-children"):
            continue
        if key == "plan" and isinstance(value, list):
            node.plans.append(_tree(value))
            continue
        if key == "cteRelations" and isinstance(value, list):
            node.ctes = {str(x["_1"]).lower(): _tree(x["_2"]) for x in value if isinstance(x, dict) and isinstance(x.get("_2"), list)}
        found = list(_expressions(value))
        if found:
            node.exprs += found
            node.named[key] = found
        else:
            node.fields[key] = value
    at += 1
    for _ in range(raw["num-children"]):
        child, at = _node(flat, at)
        node.children.append(child)
    return node, at


def _tree(flat: list[dict]) -> Node:
    return _node(flat, 0)[0]


def _expressions(value) -> Iterator[Node]:
    """Expressions in a field: each is a list of nodes in preorder; fields hold one, or lists of them."""
    if isinstance(value, list) and value:
        if isinstance(value[0], dict) and "class" in value[0]:
            yield _tree(value)
        elif isinstance(value[0], list):
            for v in value:
                yield from _expressions(v)
    elif isinstance(value, dict) and "class" not in value and "product-class" not in value:
        for v in value.values():
            yield from _expressions(v)


def parsed(spark: SparkSession, sql: str) -> Node:
    """The plan as written, before anything is resolved or run."""
    return _tree(json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON()))


def analyzed(df: DataFrame) -> Node:
    return _tree(json.loads(df._jdf.queryExecution().analyzed().toJSON()))


def optimized(df: DataFrame) -> Node:
    return _tree(json.loads(df._jdf.queryExecution().optimizedPlan().toJSON()))


def casts_as_written(filtered: DataFrame) -> list[bool]:
    """For each cast in the top filter's condition, in preorder, whether it is a TRY_CAST: the plan's JSON leaves that out."""
    import re

    return [m == "TRY_" for m in re.findall(r"(TRY_)?CAST\(", filtered._jdf.queryExecution().analyzed().condition().sql())]


def view_name(node: Node) -> str | None:
    """The table name of a View node."""
    if node.kind != "View":
        return None
    return ((node.fields.get("desc") or {}).get("identifier") or {}).get("table")
