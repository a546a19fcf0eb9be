"""The intermediate representation of a query, the same from a query string, a dictionary or the builder."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Wire operators and their names here.
OPERATORS = {
    "$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte", "$between": "between", "$in": "in", "$notIn": "notIn",
    "$null": "null", "$notNull": "notNull", "$eqi": "eqi", "$nei": "nei", "$contains": "contains", "$notContains": "notContains",
    "$containsi": "containsi", "$notContainsi": "notContainsi", "$startsWith": "startsWith", "$startsWithi": "startsWithi",
    "$endsWith": "endsWith", "$endsWithi": "endsWithi",
}
NULL_OPS, SET_OPS = {"null", "notNull"}, {"in", "notIn"}
FOLDED = {"eqi", "nei", "containsi", "notContainsi", "startsWithi", "endsWithi"}
TEXT_ONLY = FOLDED | {"contains", "notContains", "startsWith", "endsWith"}
RANGES = {"gt", "gte", "lt", "lte", "between"}


class QueryError(ValueError):
    """A query that can't be parsed or run; code and status are what an API answers with."""

    code, status = "query_invalid", 400


class NotFound(LookupError):
    code, status = "not_found", 404


class Conflict(ValueError):
    code, status = "conflict", 409


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any = True


@dataclass(frozen=True)
class And:
    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Not:
    part: Filter


@dataclass(frozen=True)
class Has:
    """Rows with at least one related row that matches."""

    relation: str
    part: Filter


Filter = Leaf | And | Or | Not | Has
NOTHING = Or(())


@dataclass(frozen=True)
class SortKey:
    field: str
    desc: bool = False


@dataclass(frozen=True)
class Page:
    """An offset page; without a limit, all rows from the offset on."""

    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Keyset:
    """A page after a cursor, or before one; an empty cursor is the first page."""

    size: int = 25
    cursor: str | None = None
    before: str | None = None
    count: bool = False


@dataclass(frozen=True)
class Populate:
    field: str
    children: tuple[Populate, ...] = ()


@dataclass(frozen=True)
class Query:
    where: Filter | None = None
    sort: tuple[SortKey, ...] = ()
    page: Page | Keyset = field(default_factory=Page)
    fields: tuple[str, ...] = ()
    populate: tuple[Populate, ...] = ()
    status: str | None = None
    locale: str | None = None


def all_of(*parts: Filter | None) -> Filter | None:
    """The conjunction of what is there, flat."""
    flat = [q for p in parts if p is not None for q in (p.parts if isinstance(p, And) else (p,))]
    return flat[0] if len(flat) == 1 else And(tuple(flat)) if flat else None
