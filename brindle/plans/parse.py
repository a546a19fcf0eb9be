"""Query strings and dictionaries to the intermediate representation. What isn't known is an error, never ignored."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any
from urllib.parse import unquote

from brindle.functions import values as V
from brindle.plans import ir
from brindle.sources.catalog import Catalog, Field

HOPS, POPULATE_NESTING, PAGE_SIZE = 3, 8, 25
Tree = dict[str, Any]


def key_path(key: str) -> list[str]:
    """filters[a][$eq] as its segments."""
    head, bracket, rest = key.partition("[")
    segments = rest.removesuffix("]").split("][") if bracket else []
    if not head or "]" in head or bracket and not rest.endswith("]") or any(not s or "[" in s or "]" in s for s in segments):
        raise ir.QueryError(f'malformed key "{key}"')
    return [head, *segments]


def _decoded(text: str) -> str:
    try:
        return unquote(text.replace("+", " "), errors="strict")
    except UnicodeDecodeError as e:
        raise ir.QueryError(f'"{text}" isn\'t UTF-8') from e


def tree_of(query: str) -> Tree:
    """Nested dictionaries of a query string; of a repeated key the last value counts."""
    root: Tree = {}
    for pair in filter(None, query.removeprefix("?").split("&")):
        key, _, value = pair.partition("=")
        *branch, last = key_path(_decoded(key))
        node = root
        for segment in branch:
            node = node.setdefault(segment, {})
            if not isinstance(node, dict):
                raise ir.QueryError(f'"{segment}" is both a value and a branch')
        if isinstance(node.get(last), dict):
            raise ir.QueryError(f'"{last}" is both a value and a branch')
        node[last] = _decoded(value)
    return root


def _wire(node: Any) -> Any:
    """Values of a Python dictionary as they are on the wire."""
    if isinstance(node, Mapping):
        return {str(k): _wire(v) for k, v in node.items()}
    if isinstance(node, list | tuple):
        return [_wire(v) for v in node]
    if isinstance(node, bool):
        return "true" if node else "false"
    if hasattr(node, "isoformat"):
        return str(V.epoch_ms(node)) if hasattr(node, "hour") else node.isoformat()
    return node if isinstance(node, str) else "" if node is None else str(node)


def _items(node: Any, what: str) -> list:
    """A list, or a dictionary keyed by 0, 1 and so on."""
    if isinstance(node, list):
        return node
    if isinstance(node, dict):
        if not all(k.isdecimal() for k in node):
            raise ir.QueryError(f"{what} must be a list")
        return [node[k] for k in sorted(node, key=int)]
    return [node]


def _names(node: Any, what: str) -> list[str]:
    """A list of strings, or one with commas; empty entries don't count."""
    entries = node.split(",") if isinstance(node, str) else _items(node, what)
    if any(not isinstance(e, str) for e in entries):
        raise ir.QueryError(f"{what} must be strings")
    return [e for e in entries if e]


def coerced(column: Field, raw: Any) -> Any:
    if not isinstance(raw, str):
        raise ir.QueryError(f"filter {column.name}: a single value is expected")
    by_kind: dict[str, Callable[[str], Any]] = {
        "i32": V.integer, "f64": V.number, "bool": V.boolean, "date": V.epoch_ms, "i64": V.int64, "string": str, "text": str,
        "decimal": lambda x: V.decimal(x, column.scale or 0, column.precision),
    }
    try:
        return by_kind[column.kind](raw)
    except V.BadValue as e:
        raise ir.QueryError(f"filter {column.name}: {e}") from e


def leaf(column: Field, token: str, raw: Any) -> ir.Leaf:
    if column.kind == "json":
        raise ir.QueryError(f'field "{column.name}" is json and can\'t be filtered')
    op = ir.OPERATORS.get(token)
    if op is None:
        raise ir.QueryError(f'unknown operator "{token}" on field "{column.name}"')
    if op in ir.TEXT_ONLY and column.kind not in ("string", "text"):
        raise ir.QueryError(f'operator {token} on field "{column.name}" requires a string field')
    if op in ir.NULL_OPS:
        if raw != "true":
            raise ir.QueryError(f"filter {column.name} {token}: value must be true")
        return ir.Leaf(column.name, op)
    if op in ir.SET_OPS or op == "between":
        parts = ([] if raw == "" and op != "between" else raw.split(",")) if isinstance(raw, str) else _items(raw, f"filter {column.name} {token}")
        if op == "between" and len(parts) != 2:
            raise ir.QueryError(f"filter {column.name} $between: 2 bounds are expected, not {len(parts)}")
        return ir.Leaf(column.name, op, tuple(coerced(column, p) for p in parts))
    return ir.Leaf(column.name, op, coerced(column, raw))


class Parser:
    """For the queries of one module of a catalog."""

    def __init__(self, catalog: Catalog, module: str):
        self.catalog, self.module = catalog, module

    def parse(self, query: str | Mapping) -> ir.Query:
        tree = tree_of(query) if isinstance(query, str) else _wire(query)
        if unknown := [k for k in tree if k not in ("filters", "sort", "pagination", "fields", "populate", "status", "locale")]:
            raise ir.QueryError(f'unknown parameter "{unknown[0]}"')
        out: dict[str, Any] = {}
        if "filters" in tree:
            out["where"] = self.filters(self.module, tree["filters"])
        if "sort" in tree:
            out["sort"] = tuple(map(self.sort_key, _names(tree["sort"], "sort")))
        if "pagination" in tree:
            out["page"] = pagination(tree["pagination"])
        if "fields" in tree:
            out["fields"] = tuple(self.public(self.module, n).name for n in _names(tree["fields"], "fields"))
        if "populate" in tree:
            out["populate"] = populate(tree["populate"])
        if "status" in tree:
            if tree["status"] not in ("draft", "published"):
                raise ir.QueryError("status must be draft or published")
            out["status"] = tree["status"]
        if "locale" in tree:
            try:
                out["locale"] = tree["locale"] if tree["locale"] == "*" else V.locale_slug(tree["locale"])
            except (V.BadValue, TypeError) as e:
                raise ir.QueryError(f"locale: {e}") from e
        return ir.Query(**out)

    def public(self, module: str, name: str) -> Field:
        found = next((f for f in self.catalog.module(module).public() if f.name == name), None)
        if found is None:
            raise ir.QueryError(f'unknown field "{name}"')
        return found

    def filters(self, module: str, node: Any, hops: int = 0) -> ir.Filter:
        if not isinstance(node, dict) or not node:
            raise ir.QueryError("filters must be fields and logical operators")
        parts: list[ir.Filter] = []
        for key, value in node.items():
            if key in ("$and", "$or"):
                if isinstance(value, str) or not (entries := _items(value, key)):
                    raise ir.QueryError(f"{key} must be a list of filters, not an empty one")
                sub = tuple(self.filters(module, e, hops) for e in entries)
                parts.append(ir.And(sub) if key == "$and" else ir.Or(sub))
            elif key == "$not":
                parts.append(ir.Not(self.filters(module, value, hops)))
            elif key.startswith("$"):
                raise ir.QueryError(f'unknown logical operator "{key}"')
            else:
                parts.append(self.condition(module, key, value, hops))
        return parts[0] if len(parts) == 1 else ir.And(tuple(parts))

    def condition(self, module: str, name: str, value: Any, hops: int) -> ir.Filter:
        side = self.catalog.sides(module).get(name)
        if side is None or self.catalog.module(module).column(name):
            column = self.public(module, name)
            if isinstance(value, str):
                return leaf(column, "$eq", value)
            if not isinstance(value, dict) or not value:
                raise ir.QueryError(f'filter on field "{name}" must be operators with values')
            leaves = tuple(leaf(column, op, v) for op, v in value.items())
            return leaves[0] if len(leaves) == 1 else ir.And(leaves)
        if hops >= HOPS:
            raise ir.QueryError(f'filter over more than {HOPS} relations at "{name}"')
        if not isinstance(value, dict) or value and all(k in ir.OPERATORS for k in value):
            raise ir.QueryError(f'relation "{name}" must be filtered by a field of its target')
        if side.target not in self.catalog.modules:
            raise ir.QueryError(f'the target of relation "{name}" is not available')
        return ir.Has(name, self.filters(side.target, value, hops + 1))

    def sort_key(self, token: str) -> ir.SortKey:
        name, _, direction = token.partition(":")
        if ":" in token and direction not in ("asc", "desc"):
            raise ir.QueryError(f'sort direction must be asc or desc, not "{direction}"')
        return ir.SortKey(self.public(self.module, name).name, direction == "desc")


def _count(tree: Tree, key: str, default: int, least: int = 0) -> int:
    raw = tree.get(key, str(default))
    try:
        n = V.integer(raw) if isinstance(raw, str) else -1
    except V.BadValue:
        n = -1
    if n < least:
        raise ir.QueryError(f"pagination[{key}] must be an integer from {least} on")
    return n


def pagination(tree: Any) -> ir.Page | ir.Keyset:
    """page and pageSize, start and limit, or a cursor (before, or after it) with pageSize: one of them alone."""
    if not isinstance(tree, dict):
        raise ir.QueryError("pagination must be an object")
    keys = set(tree)
    if unknown := keys - {"page", "pageSize", "start", "limit", "cursor", "before", "withCount"}:
        raise ir.QueryError(f'unknown pagination key "{min(unknown)}"')
    by_cursor = keys & {"cursor", "before"}
    by_page = keys & ({"page"} if by_cursor else {"page", "pageSize"})
    by_start = keys & {"start", "limit"}
    if sum(map(bool, (by_cursor, by_page, by_start))) > 1 or len(by_cursor) > 1:
        raise ir.QueryError("pagination: page, start, cursor and before exclude one another")
    if "withCount" in keys and not by_cursor:
        raise ir.QueryError("pagination[withCount] needs a cursor")
    if by_cursor:
        if tree.get("withCount", "false") not in ("true", "false") or not isinstance(token := tree[by_cursor.pop()], str):
            raise ir.QueryError("pagination: withCount must be true or false, and a cursor a string")
        if "before" in keys and not token:
            raise ir.QueryError("pagination[before] must be a cursor")
        place = {"before": token} if "before" in keys else {"cursor": token}
        return ir.Keyset(_count(tree, "pageSize", PAGE_SIZE, 1), count=tree.get("withCount") == "true", **place)
    if by_page:
        size = _count(tree, "pageSize", PAGE_SIZE)
        return ir.Page((_count(tree, "page", 1, 1) - 1) * size, size)
    return ir.Page(_count(tree, "start", 0), _count(tree, "limit", 0) if "limit" in keys else None)


def populate(node: Any, nesting: int = 0) -> tuple[ir.Populate, ...]:
    """Names are resolved where the query runs. Deeper levels than are followed parse, up to a limit."""
    if nesting > POPULATE_NESTING:
        raise ir.QueryError(f"populate nested deeper than {POPULATE_NESTING} levels")
    if isinstance(node, dict) and not (node and all(k == str(i) for i, k in enumerate(node))):
        return tuple(ir.Populate(k, populate(v["populate"], nesting + 1) if isinstance(v, dict) and "populate" in v else ()) for k, v in node.items())
    return tuple(ir.Populate(n) for n in _names(node, "populate"))


# -- what identifies a query --------------------------------------------------


def canonical(node: Any) -> str:
    """One text for queries that mean the same: order of conditions and of set members doesn't count."""
    if isinstance(node, ir.Leaf):
        value = sorted(map(canonical, node.value)) if node.op in ir.SET_OPS else canonical(node.value)
        return json.dumps(["leaf", node.field, node.op, value])
    if isinstance(node, ir.And | ir.Or):
        return json.dumps([type(node).__name__, sorted(map(canonical, node.parts))])
    if isinstance(node, ir.Not):
        return json.dumps(["Not", canonical(node.part)])
    if isinstance(node, ir.Has):
        return json.dumps(["Has", node.relation, canonical(node.part)])
    if isinstance(node, ir.Query):
        return json.dumps([canonical(getattr(node, f)) for f in ("where", "sort", "page", "fields", "populate", "status", "locale")])
    if isinstance(node, tuple):
        return json.dumps([canonical(x) for x in node])
    return json.dumps([type(node).__name__, repr(node)])
