"""Queries built in Python: f("views").gt(10).and_(f("author", "name").eq("Ann")). They are dictionaries of the wire's
form, so that they are checked against the schema as any other."""

from __future__ import annotations

import re
from typing import Any

from brindle.plans.ir import OPERATORS


class Condition:
    """A filter; combine with and_, or_, not_ or with &, | and ~."""

    def __init__(self, tree: dict[str, Any]):
        self.tree = tree

    def _joined(self, op: str, others: tuple[Condition | dict, ...]) -> Condition:
        own = self.tree[op] if list(self.tree) == [op] else [self.tree]
        return Condition({op: [*own, *(o.tree if isinstance(o, Condition) else o for o in others)]})

    def and_(self, *others: Condition | dict) -> Condition:
        return self._joined("$and", others)

    def or_(self, *others: Condition | dict) -> Condition:
        return self._joined("$or", others)

    def not_(self) -> Condition:
        return Condition({"$not": self.tree})

    def __and__(self, other: Condition) -> Condition:
        return self.and_(other)

    def __or__(self, other: Condition) -> Condition:
        return self.or_(other)

    def __invert__(self) -> Condition:
        return self.not_()


class FieldRef:
    """A field, or with several names a field behind relations. It has a method for each operator."""

    def __init__(self, *path: str):
        self.path = path

    def where(self, op: str, value: Any = True) -> Condition:
        tree: dict[str, Any] = {op: value}
        for name in reversed(self.path):
            tree = {name: tree}
        return Condition(tree)


def _add(token: str) -> None:
    name = re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), token[1:])
    name += "_" if name == "in" else ""
    if token in ("$in", "$notIn"):
        method = lambda self, *values: self.where(token, list(values[0] if len(values) == 1 and isinstance(values[0], list | tuple | set) else values))
    elif token == "$between":
        method = lambda self, low, high: self.where(token, [low, high])
    elif token in ("$null", "$notNull"):
        method = lambda self: self.where(token)
    else:
        method = lambda self, value: self.where(token, value)
    setattr(FieldRef, name, method)


for _token in OPERATORS:
    _add(_token)


def f(*path: str) -> FieldRef:
    return FieldRef(*path)


def query(filters: Condition | dict | None = None, **parts: Any) -> dict[str, Any]:
    """A query's dictionary; parts: sort, pagination, fields, populate, status, locale."""
    where = filters.tree if isinstance(filters, Condition) else filters
    return {**({"filters": where} if where else {}), **{k: v for k, v in parts.items() if v is not None}}


def from_list_state(search: str | None, search_field: str | None, rows: list[dict], sort: list[tuple[str, bool]] = (), page: int = 1, page_size: int = 25) -> dict[str, Any]:
    """The query of a list view: a free text, rows of field, op and value, sort keys, and a page."""
    parts = [{search_field: {"$containsi": search.strip()}}] if search and search.strip() and search_field else []
    parts += [{r["field"]: {r["op"]: r.get("value", True)}} for r in rows]
    filters = {} if not parts else parts[0] if len(parts) == 1 else {"$and": parts}
    order = [f"{name}:{'desc' if desc else 'asc'}" for name, desc in sort]
    return query(filters, sort=order or None, pagination={"page": page, "pageSize": page_size})
