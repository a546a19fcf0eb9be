"""Sorting, offset pages and keyset pages."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import ms_instant
from brindle.operators.filters import column
from brindle.plans import ir
from brindle.sources.catalog import Field, Module

#: What a null counts as where rows are sorted for offset pages: it stands among the real ones.
SENTINELS = {"i32": "0", "f64": "0D", "bool": "false", "string": "''", "text": "''", "json": "'null'", "i64": "0L", "decimal": "0", "date": "timestamp_ntz'1970-01-01'"}


def sort_value(field: Field) -> Column:
    c = ms_instant(column(field.name)).cast("timestamp_ntz") if field.kind == "date" else column(field.name)
    return F.coalesce(c, F.expr(SENTINELS[field.kind]).cast(field.spark))


def ordering(module: Module, sort: tuple[ir.SortKey, ...]) -> list[Column]:
    """For offset pages. Ties go by ascending id, but where the one key is a descending number or date, by descending
    id; strings go by code point."""
    own = module.id_field.name
    keys = [sort_value(module.column(s.field)) for s in sort]
    order = [k.desc() if s.desc else k.asc() for k, s in zip(keys, sort, strict=True)]
    turned = len(sort) == 1 and sort[0].desc and module.column(sort[0].field).kind in ("i32", "f64", "date", "i64", "decimal") and sort[0].field not in (own, "document_id", "published_at")
    return [*order, column(own).desc() if turned else column(own).asc()]


def offset_page(rows: DataFrame, module: Module, sort: tuple[ir.SortKey, ...], page: ir.Page) -> DataFrame:
    """With a limit Spark keeps the first offset + limit rows of each partition and never sorts all."""
    if page.limit == 0:
        return rows.limit(0)
    ordered = rows.orderBy(*ordering(module, sort))
    if page.offset:
        ordered = ordered.offset(page.offset)
    return ordered if page.limit is None else ordered.limit(page.limit)


# -- keyset pages: nulls are last in ascending and first in descending order --


def keyset_keys(module: Module, sort: tuple[ir.SortKey, ...]) -> tuple[ir.SortKey, ...]:
    """The sort with id after it, if it hasn't id itself: a total order."""
    own = module.id_field.name
    for s in sort:
        if module.column(s.field).kind == "json":
            raise ir.QueryError(f'keyset pages can\'t be sorted by json field "{s.field}"')
    kept = []
    for s in sort:
        kept.append(s)
        if s.field == own:
            break
    return tuple(kept) if kept and kept[-1].field == own else (*kept, ir.SortKey(own))


def keyset_value(field: Field) -> Column:
    return ms_instant(column(field.name)).cast("timestamp_ntz") if field.kind == "date" else column(field.name)


def _beyond(c: Column, bound: Column | None, desc: bool, forward: bool) -> Column:
    """Rows whose key comes strictly after the boundary's, or before it."""
    rising = desc != forward  # towards greater values, and nulls at that end
    if bound is None:
        return F.lit(False) if rising else c.isNotNull()
    return (c > bound) | c.isNull() if rising else (c < bound) & c.isNotNull()


def seek(module: Module, keys: tuple[ir.SortKey, ...], bounds: list[Column | None], forward: bool) -> Column:
    """One disjunct per key, where the keys before it are equal. The first key's bound stands before them all once
    more, for the scan to prune by, unless nulls lie beyond it."""
    parts, equal = [], []
    for s, bound in zip(keys, bounds, strict=True):
        c = keyset_value(module.column(s.field))
        parts.append(reduce(and_, equal, _beyond(c, bound, s.desc, forward)) if equal else _beyond(c, bound, s.desc, forward))
        equal.append(c.isNull() if bound is None else c.eqNullSafe(bound))
    first, lead = module.column(keys[0].field), bounds[0]
    whole = reduce(or_, parts)
    if lead is not None and first.kind != "date":
        c = column(first.name)
        rising = keys[0].desc != forward
        whole = ((c >= lead) | c.isNull() if rising else c <= lead) & whole
    return whole


def keyset_order(module: Module, keys: tuple[ir.SortKey, ...], forward: bool) -> list[Column]:
    out = []
    for s in keys:
        c = keyset_value(module.column(s.field))
        out.append(c.asc_nulls_last() if s.desc != forward else c.desc_nulls_first())
    return out


def keyset_page(rows: DataFrame, module: Module, keys: tuple[ir.SortKey, ...], bounds: list[Any] | None, forward: bool, size: int) -> DataFrame:
    """size + 1 rows, the last one telling whether there are more; backward pages come in backward order."""
    if bounds is not None:
        rows = rows.filter(seek(module, keys, bounds, forward))
    return rows.orderBy(*keyset_order(module, keys, forward)).limit(size + 1)
