"""Filters as Spark predicates and semi-joins.

Every leaf has two values: a null matches no leaf but $null, and not() is the complement over all rows. A leaf is
`predicate AND column IS NOT NULL`, which is never null and reaches the Parquet scan. Relations that stand alone in
the conjunction are semi- and anti-joins; elsewhere they are a flag from a join with the distinct owners.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from itertools import count
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import values as V
from brindle.functions.columns import folded
from brindle.plans import ir
from brindle.sources.catalog import Catalog, Field, Side

_I32 = 1 << 31


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def literal(field: Field, value: Any) -> Column:
    if field.kind == "i32":
        return F.lit(value) if isinstance(value, int) and -_I32 <= value < _I32 else F.lit(float(value))
    if field.kind == "f64":
        return F.lit(float(value))
    if field.kind == "i64":
        return F.lit(value).cast("long")
    if field.kind == "decimal":
        return F.lit(str(value)).cast(field.spark)
    return F.lit(value)


def _instants(c: Column, op: str, value: Any) -> Column:
    """Stored instants count by their millisecond: bounds are moved so that the column stays bare for the scan."""
    at = lambda ms: F.lit(V.instant(ms)).cast("timestamp_ntz")
    after = lambda ms: F.lit(V.instant(ms) + timedelta(milliseconds=1) if V.instant(ms) < datetime(9999, 12, 31, 23, 59, 59) else V.instant(ms)).cast("timestamp_ntz")
    same = lambda ms: (c >= at(ms)) & (c < after(ms))
    if op in ("in", "notIn"):
        any_of = reduce(or_, map(same, value))
        return any_of if op == "in" else ~any_of
    if op == "between":
        return (c >= at(value[0])) & (c < after(value[1]))
    table = {"eq": same, "ne": lambda v: ~same(v), "gt": lambda v: c >= after(v), "gte": lambda v: c >= at(v), "lt": lambda v: c < at(v), "lte": lambda v: c < after(v)}
    return table[op](value)


def leaf(field: Field, op: str, value: Any) -> Column:
    c, kind = column(field.name), field.kind
    if op == "null":
        return c.isNull()
    if op == "notNull":
        return c.isNotNull()
    never = kind == "bool" and op in ir.RANGES or kind == "string" and op == "between" or kind == "text" and op in ir.RANGES | ir.SET_OPS
    if never or op == "in" and not value:
        return F.lit(False)
    if op == "notIn" and not value:
        return c.isNotNull()
    if kind == "date":
        return _instants(c, op, value) & c.isNotNull()
    if op in ir.FOLDED:
        c_, v = folded(c), F.lit(V.fold(value))
        table = {"eqi": lambda: c_ == v, "nei": lambda: c_ != v, "containsi": lambda: c_.contains(v), "notContainsi": lambda: ~c_.contains(v), "startsWithi": lambda: c_.startswith(v), "endsWithi": lambda: c_.endswith(v)}
        return table[op]() & c.isNotNull()
    v = [literal(field, x) for x in value] if isinstance(value, tuple) else literal(field, value)
    table = {
        "eq": lambda: c == v, "ne": lambda: c != v, "gt": lambda: c > v, "gte": lambda: c >= v, "lt": lambda: c < v, "lte": lambda: c <= v,
        "between": lambda: c.between(*v), "in": lambda: c.isin(*v), "notIn": lambda: ~c.isin(*v), "contains": lambda: c.contains(v),
        "notContains": lambda: ~c.contains(v), "startsWith": lambda: c.startswith(v), "endsWith": lambda: c.endswith(v),
    }
    return table[op]() & c.isNotNull()


class Filters:
    """Applies filters to the rows of a catalog's modules."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.numbers = catalog, count()

    def apply(self, rows: DataFrame, module: str, where: ir.Filter | None) -> DataFrame:
        if where is None:
            return rows
        parts = where.parts if isinstance(where, ir.And) else (where,)
        plain = [p for p in parts if not _has_relation(p)]
        if plain:
            rows = rows.filter(reduce(and_, (self.predicate(module, p) for p in plain)))
        flagged, columns = [], rows.columns
        for part in parts:
            if part in plain:
                continue
            inner, anti = (part.part, True) if isinstance(part, ir.Not) else (part, False)
            if isinstance(inner, ir.Has):
                mine, keys = self.owners(module, inner)
                rows = rows.join(keys, rows[mine] == keys["_owner"], "left_anti" if anti else "left_semi")
            else:
                flagged.append(part)
        for part in flagged:
            rows, predicate = self._flags(rows, module, part)
            rows = rows.filter(predicate)
        return rows.select(*map(column, columns)) if flagged else rows

    def predicate(self, module: str, node: ir.Filter, flags: dict[int, Column] | None = None) -> Column:
        if isinstance(node, ir.Leaf):
            return leaf(self.catalog.module(module).column(node.field), node.op, node.value)
        if isinstance(node, ir.And):
            return reduce(and_, (self.predicate(module, p, flags) for p in node.parts)) if node.parts else F.lit(True)
        if isinstance(node, ir.Or):
            return reduce(or_, (self.predicate(module, p, flags) for p in node.parts)) if node.parts else F.lit(False)
        if isinstance(node, ir.Has):
            return flags[id(node)]
        if isinstance(node.part, ir.Leaf) and node.part.op == "eq" and self.catalog.module(module).column(node.part.field).kind != "date":
            field = self.catalog.module(module).column(node.part.field)
            return ~column(field.name).eqNullSafe(literal(field, node.part.value))
        return ~self.predicate(module, node.part, flags)

    def _flags(self, rows: DataFrame, module: str, node: ir.Filter) -> tuple[DataFrame, Column]:
        flags: dict[int, Column] = {}
        for has in _relations(node):
            name = f"_has_{next(self.numbers)}"
            mine, keys = self.owners(module, has)
            keys = keys.distinct().select(F.col("_owner").alias(f"{name}_owner"), F.lit(True).alias(name))
            rows = rows.join(keys, rows[mine] == keys[f"{name}_owner"], "left")
            flags[id(has)] = F.coalesce(F.col(name), F.lit(False))
        return rows, self.predicate(module, node, flags)

    def owners(self, module: str, has: ir.Has) -> tuple[str, DataFrame]:
        """The column of module's rows, and the values (_owner) that it has where a related row matches."""
        side = self.catalog.sides(module)[has.relation]
        target = self.apply(self.catalog.rows[side.target], side.target, has.part)
        return related_keys(self.catalog, side, target)


def related_keys(catalog: Catalog, side: Side, target: DataFrame) -> tuple[str, DataFrame]:
    own, other = catalog.module(side.owner).id_field.name, catalog.module(side.target).id_field.name
    if side.relation.column and side.here == "owner_id":  # a key in the owner's own rows
        return side.relation.column, target.select(column(other).alias("_owner"))
    if side.relation.column:
        return own, target.select(column(side.relation.column).alias("_owner"))
    link = catalog.links[side.link]
    found = target.select(column(other).alias("_there"))
    return own, link.join(found, link[side.there] == found["_there"], "left_semi").select(F.col(side.here).alias("_owner"))


def _has_relation(node: ir.Filter) -> bool:
    return any(True for _ in _relations(node))


def _relations(node: ir.Filter):
    """Relation leaves of this module; those behind them are their own matter."""
    if isinstance(node, ir.Has):
        yield node
    elif isinstance(node, ir.Not):
        yield from _relations(node.part)
    elif isinstance(node, ir.And | ir.Or):
        for part in node.parts:
            yield from _relations(part)
