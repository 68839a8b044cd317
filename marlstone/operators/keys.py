"""Relationships between tables: declared, inferred from names and data, inferred from containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KEY_SUFFIXES, is_key_like

ORPHAN_RATE = 0.05


def _text(c: str) -> Column:
    return F.trim(F.col(f"`{c}`").cast("string"))


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """One row (children, orphans): child values that are not null, and those among them without a parent; compared as text."""
    c = child.where(F.col(f"`{child_col}`").isNotNull()).groupBy(_text(child_col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    p = parent.where(F.col(f"`{parent_col}`").isNotNull()).select(_text(parent_col).alias("pk")).distinct()
    both = c.join(p, c["k"] == p["pk"], "left")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("children"), F.coalesce(F.sum(F.when(F.col("pk").isNull(), F.col("n"))), F.lit(0)).alias("orphans"))


def contained(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, most: float = ORPHAN_RATE) -> DataFrame:
    """As ``orphans``, with ``holds``: whether at most a share ``most`` of the children lack a parent (and there are children)."""
    return orphans(child, child_col, parent, parent_col).withColumn("holds", (F.col("children") > 0) & (F.col("orphans") <= most * F.col("children")))


def stem(column: str) -> str:
    """What an identifier column names: claim_identifier -> claim."""
    low = column.lower()
    return next((column[: -len(s)] for s in KEY_SUFFIXES if low.endswith(s)), column)


def is_key(df: DataFrame, column: str) -> bool:
    c = F.col(f"`{column}`")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("d"), F.count(c).alias("c")).first()
    return r["n"] > 0 and r["d"] == r["n"] == r["c"]


def infer(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(child, column, parent, column): an identifier column that another table is named by, has, and holds as a key, all of
    whose values exist there."""
    out = []
    for name, child in sorted(tables.items()):
        for c in child.columns:
            parent = stem(c)
            if is_key_like(c) and parent != name and parent in tables and c in tables[parent].columns and is_key(tables[parent], c):
                if orphans(child, c, tables[parent], c).first()["orphans"] == 0:
                    out.append((name, c, parent, c))
    return out


def unprefixed(column: str) -> str:
    """A column's name without its table's short prefix: l_orderkey -> orderkey."""
    head, _, rest = column.partition("_")
    return rest if rest and len(head) <= 3 else column


def infer_by_containment(tables: dict[str, DataFrame], most: float = ORPHAN_RATE, suffixes: tuple[str, ...] = ("key", "id")) -> list[tuple[str, str, str, str]]:
    """As ``infer``, for columns that agree once short prefixes are left out, with a share of orphans allowed.

    Parents: the first unique column of a table that is named like a key and has other columns beside keys.
    """
    keyed = lambda c: unprefixed(c).lower().endswith(suffixes)
    parents = {}
    for name, df in sorted(tables.items()):
        plain = [c for c in df.columns if not keyed(c)]
        first = next((c for c in df.columns if keyed(c) and unprefixed(c).lower().startswith(name[:4].lower()) and is_key(df, c)), None)
        if first and plain:
            parents[unprefixed(first).lower()] = (name, first)
    out = []
    for name, df in sorted(tables.items()):
        for c in df.columns:
            p = parents.get(unprefixed(c).lower())
            if p and p[0] != name and contained(df, c, tables[p[0]], p[1], most).first()["holds"]:
                out.append((name, c, *p))
    return out


def declared(rows: DataFrame) -> DataFrame:
    """Foreign-key rows (child, column, parent, parent_column, constraint_id, position) as relationships with their keys:
    one per child and constraint, so that two keys to one parent stay two."""
    keys = F.transform(F.sort_array(F.collect_list(F.struct("position", "column", "parent_column"))), lambda k: F.concat_ws("=", k["column"], k["parent_column"]))
    return rows.groupBy("child", "parent", "constraint_id").agg(F.array_join(keys, ",").alias("join_keys"))


def merge(declared_rows: DataFrame, inferred: DataFrame) -> DataFrame:
    """Declared relationships, and inferred ones of children that declare none; columns (child, parent, join_keys)."""
    extra = inferred.join(declared_rows.select("child").distinct(), "child", "left_anti")
    return declared_rows.select("child", "parent", "join_keys").unionByName(extra.select("child", "parent", "join_keys"))


def align_types(pairs: list[tuple[str, str]], kinds: dict[str, str], lossless: dict[tuple[str, str], bool]) -> dict[str, str]:
    """One type for each set of columns that keys connect: the first type to which all of them cast without loss.

    ``lossless``: (column, type) -> whether every value survives the cast and back.
    """
    up = {c: c for p in pairs for c in p}

    def root(c: str) -> str:
        while up[c] != c:
            c = up[c]
        return c

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    out = {}
    for r in {root(c) for c in up}:
        group = sorted(c for c in up if root(c) == r)
        for kind in sorted({kinds[c] for c in group}):
            if all(kinds[c] == kind or lossless.get((c, kind), False) for c in group):
                out |= dict.fromkeys(group, kind)
                break
    return out


def cast_is_lossless(df: DataFrame, column: str, kind: str) -> DataFrame:
    """One row (lost): values that the cast to ``kind`` and back changes."""
    c = F.col(f"`{column}`")
    back = c.try_cast(kind).try_cast(df.schema[column].dataType)
    return df.agg(F.count_if(c.isNotNull() & ~c.eqNullSafe(back)).alias("lost"))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the last right row of its ``by`` whose ``on`` is not later; null where there is none.

    One shuffle of both sides by ``by`` and a window, instead of a join on a range. Of right rows at the same ``on``, that
    with the largest ``take`` counts. Columns of ``take`` come out as right_<name>.
    """
    l = left.select(*(F.col(c) for c in left.columns), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{right.schema[c].dataType.simpleString()}" for c in take) + ">").alias("__r"), F.lit(1).alias("__side"))
    r = right.select(*(F.col(c) if c in (on, *by) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.struct(*take).alias("__r"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(F.col(on).asc_nulls_first(), "__side", F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return both.select(*left.columns, *(F.when(F.col(on).isNotNull(), F.col(f"__last.{c}")).alias(f"right_{c}") for c in take))


def combine_facts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables, each aggregated at ``keys``, side by side: null keys meet, groups of one side stay."""
    y = b.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in b.columns if c not in keys))
    same = None
    for k in keys:
        one = a[k].eqNullSafe(y[f"__{k}"])
        same = one if same is None else same & one
    return a.join(y, same, "full").select(*(F.coalesce(a[k], y[f"__{k}"]).alias(k) for k in keys), *(c for c in a.columns + y.columns if c not in keys and not c.startswith("__")))
