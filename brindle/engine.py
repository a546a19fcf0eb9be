"""The engine: lists, single rows and counts over a catalog, as DataFrames or as the wire's JSON."""

from __future__ import annotations

import json
import math
import re
from collections import OrderedDict
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import render
from brindle.functions import values as V
from brindle.operators import paging
from brindle.operators.components import expand_components
from brindle.operators.filters import Filters, column, literal
from brindle.operators.populate import Populator, resolved
from brindle.operators.visibility import DEFAULT_LOCALE, visible
from brindle.plans import ir
from brindle.plans.cursor import CursorCodec
from brindle.plans.parse import Parser, canonical
from brindle.sources.catalog import Catalog, Field, Module

Input = str | Mapping | ir.Query


class Engine:
    def __init__(self, catalog: Catalog | None = None, secret: bytes | str = "unset", default_locale: str = DEFAULT_LOCALE, cached: int = 1024):
        self.catalog = catalog or Catalog()
        self.cursors = CursorCodec(secret)
        self.default_locale, self.cached = default_locale, cached
        self.cache: OrderedDict[tuple, str] = OrderedDict()
        self.components: dict[str, Module] = {}

    # -- plans ------------------------------------------------------------------

    def parse(self, module: str, query: Input) -> ir.Query:
        self.catalog.module(module)
        return query if isinstance(query, ir.Query) else Parser(self.catalog, module).parse(query)

    def where(self, module: str, query: ir.Query) -> ir.Filter | None:
        return ir.all_of(query.where, visible(self.catalog.module(module), query.status, query.locale, self.default_locale))

    def matching(self, module: str, query: Input = "") -> DataFrame:
        """All rows that match, all columns, in no order."""
        query = self.parse(module, query)
        return Filters(self.catalog).apply(self.catalog.rows[module], module, self.where(module, query))

    def shown(self, module: str, query: ir.Query) -> list[Field]:
        """Public columns, or of them id and those asked for; in the schema's order always."""
        own = self.catalog.module(module)
        return [f for f in own.public() if not query.fields or f.name in query.fields or f.name == own.id_field.name]

    def frame(self, module: str, query: Input = "") -> DataFrame:
        """The page of an offset query, or the first keyset page, with its relations, as a DataFrame in order."""
        query = self.parse(module, query)
        own = self.catalog.module(module)
        if isinstance(query.page, ir.Keyset):
            page = self._keyset_rows(module, query)[0].limit(query.page.size)
        else:
            page = paging.offset_page(self.matching(module, query), own, query.sort, query.page)
        return self._finished(page, own, query)

    def _finished(self, page: DataFrame, own: Module, query: ir.Query) -> DataFrame:
        fields = [f.name for f in self.shown(own.name, query)]
        plan = resolved(self.catalog, own, query.populate)
        if not plan:
            return page.select(*map(column, fields))
        relations = [n for n in plan if n not in fields]
        keys = {own.id_field.name, *(s.relation.column for n, s in self.catalog.sides(own.name).items() if n in plan and s.relation.column and s.here == "owner_id")}
        needed = [c for c in page.columns if c in keys or c in fields]
        out = Populator(self.catalog).expand(page.select(*map(column, needed)), own, query.populate)
        return out.select(*map(column, [*fields, *(n for n in relations if n in out.columns)]))

    # -- reads as JSON ------------------------------------------------------------

    def list(self, module: str, query: Input = "") -> str:
        """{"data": [...], "meta": {"pagination": ...}}. Answers of queries without relations are kept, by what they
        mean and the version of the rows."""
        query = self.parse(module, query)
        plain = not query.populate and not isinstance(query.page, ir.Keyset) and "Has" not in canonical(query.where)
        key = (module, canonical(query), self.catalog.stored, self.catalog.versions.get(module))
        if plain and key in self.cache:
            self.cache.move_to_end(key)
            return self.cache[key]
        out = self._keyset_list(module, query) if isinstance(query.page, ir.Keyset) else self._offset_list(module, query)
        if plain and self.cached:
            self.cache[key] = out
            if len(self.cache) > self.cached:
                self.cache.popitem(last=False)
        return out

    def changed(self, module: str) -> None:
        """Drops what is kept of a module."""
        for key in [k for k in self.cache if k[0] == module]:
            del self.cache[key]

    def _rendered(self, page: DataFrame, own: Module, query: ir.Query, keep_order: list | None = None) -> list[str]:
        finished = self._finished(page, own, query)
        rows = finished.collect()
        if keep_order is not None:
            place = {k: i for i, k in enumerate(keep_order)}
            rows.sort(key=lambda r: place[r[own.id_field.name]])
        plan = self._nested(own, query.populate)
        fields = self.shown(own.name, query)
        nested = {n: p for n, p in plan.items() if own.column(n) is None}
        out = [render.row(fields, nested, r) for r in rows]
        return expand_components(self, own, query, out)

    def _nested(self, own: Module, nodes: tuple[ir.Populate, ...], depth: int = 1) -> dict[str, Any]:
        sides, out = self.catalog.sides(own.name), {}
        for name, children in resolved(self.catalog, own, nodes, depth).items():
            if name in sides:
                target = self.catalog.module(sides[name].target)
                out[name] = (list(target.public()), self._nested(target, children, depth + 1) if depth < 2 else {})
        return out

    def _ids(self, page: DataFrame, own: Module) -> list:
        return [r[0] for r in page.select(column(own.id_field.name)).collect()]

    def _offset_list(self, module: str, query: ir.Query) -> str:
        own, page = self.catalog.module(module), query.page
        matching = self.matching(module, query)
        total = matching.count()
        size = total if page.limit is None else page.limit
        rows = paging.offset_page(matching, own, query.sort, page)
        if query.populate:  # joins lose the order: the page's ids, which are few, bring it back
            ids = self._ids(rows, own)
            rows = self._by_ids(module, ids)
            data = self._rendered(rows, own, query, ids)
        else:
            data = self._rendered(rows, own, query)
        meta = {"page": page.offset // size + 1 if size else 1, "pageSize": size, "pageCount": math.ceil(total / size) if size else 0, "total": total}
        return render.envelope(data, {"pagination": meta})

    def _by_ids(self, module: str, ids: list) -> DataFrame:
        own = self.catalog.module(module).id_field.name
        return self.catalog.rows[module].filter(column(own).isin(ids) if ids else F.lit(False))

    # -- keyset pages -------------------------------------------------------------

    def _context(self, module: str, keys: tuple[ir.SortKey, ...], query: ir.Query) -> tuple:
        return module, self.catalog.versions.get(module, 1), keys, self.where(module, query)

    def _bounds(self, own: Module, keys: tuple[ir.SortKey, ...], token: str, context: tuple) -> list:
        found, row_id = self.cursors.decode(token, *context)
        bounds = []
        for s, v in zip(keys, [*found, row_id] if keys[-1].field == own.id_field.name and len(found) < len(keys) else found, strict=True):
            field = own.column(s.field)
            if v is not None and field.kind == "date":
                bounds.append(F.lit(V.instant(v)).cast("timestamp_ntz"))
            else:
                bounds.append(None if v is None else literal(field, v))
        return bounds

    def _keyset_rows(self, module: str, query: ir.Query) -> tuple[DataFrame, tuple[ir.SortKey, ...], tuple, bool]:
        own = self.catalog.module(module)
        keys = paging.keyset_keys(own, query.sort)
        context = self._context(module, keys, query)
        forward = query.page.before is None
        token = query.page.cursor if forward else query.page.before
        bounds = self._bounds(own, keys, token, context) if token else None
        return paging.keyset_page(self.matching(module, query), own, keys, bounds, forward, query.page.size), keys, context, forward

    def _keyset_list(self, module: str, query: ir.Query) -> str:
        own, size = self.catalog.module(module), query.page.size
        rows, keys, context, forward = self._keyset_rows(module, query)
        found = rows.select(*(paging.keyset_value(own.column(s.field)).alias(f"k{i}") for i, s in enumerate(keys)), column(own.id_field.name).alias("id")).collect()
        more, found = len(found) > size, found[:size]
        if not forward:
            found.reverse()
        ids = [r["id"] for r in found]
        data = self._rendered(self._by_ids(module, ids), own, query, ids) if ids else []
        token = lambda r: self.cursors.encode([r[f"k{i}"] for i, s in enumerate(keys) if s.field != own.id_field.name], r["id"], *context)
        meta: dict[str, Any] = {
            "pageSize": size,
            "hasNextPage": more if forward else True,
            "hasPreviousPage": bool(query.page.cursor) if forward else more,
            "nextCursor": token(found[-1]) if found else None,
            "prevCursor": token(found[0]) if found else None,
        }
        if query.page.count:
            total = self.matching(module, query).count()
            meta |= {"total": total, "pageCount": math.ceil(total / size)}
        return render.envelope(data, {"pagination": meta})

    # -- single rows and counts -----------------------------------------------------

    def find_one(self, module: str, row_id: int | str, query: Input = "") -> str:
        """{"data": {...}, "meta": {}}, or NotFound: also where the reader may not see the row. Filters, sort and
        pagination of the query must parse and count for nothing."""
        query = self.parse(module, query)
        own = self.catalog.module(module)
        if not re.fullmatch(r"0|-?[1-9]\d{0,18}", str(row_id)):
            raise ir.NotFound(f'no "{module}" {row_id}')
        gate = visible(own, query.status, query.locale, self.default_locale)
        where = ir.all_of(ir.Leaf(own.id_field.name, "eq", int(row_id)), gate)
        rows = Filters(self.catalog).apply(self.catalog.rows[module], module, where).limit(1)
        data = self._rendered(rows, own, query)
        if not data:
            raise ir.NotFound(f'no "{module}" {row_id}')
        return render.envelope(data[0], {})

    def find_one_or_none(self, module: str, row_id: int | str, query: Input = "") -> str | None:
        try:
            return self.find_one(module, row_id, query)
        except ir.NotFound:
            return None

    def count(self, module: str, query: Input = "") -> int:
        return self.matching(module, query).count()

    def list_all(self, module: str, query: Mapping | None = None, page_size: int = 100) -> Iterator[dict]:
        """Every row, page by page. In the default order, that of the id, pages seek by cursor; in another one, whose
        place for nulls cursors don't share, they go by offset and count anew."""
        if not (query or {}).get("sort"):
            yield from self.list_all_keyset(module, query, page_size)
            return
        page = 1
        while True:
            answer = json.loads(self.list(module, {**(query or {}), "pagination": {"page": page, "pageSize": page_size}}))
            yield from answer["data"]
            if page >= answer["meta"]["pagination"]["pageCount"]:
                return
            page += 1

    def list_all_keyset(self, module: str, query: Mapping | None = None, page_size: int = 100) -> Iterator[dict]:
        """Every row, page by page, by cursor: rows written meanwhile shift nothing."""
        cursor = ""
        while True:
            answer = json.loads(self.list(module, {**(query or {}), "pagination": {"cursor": cursor, "pageSize": page_size}}))
            yield from answer["data"]
            if not answer["meta"]["pagination"]["hasNextPage"]:
                return
            cursor = answer["meta"]["pagination"]["nextCursor"]

    def decoded(self, module: str, data: dict) -> dict:
        """A rendered row with Python values: integers, decimals, instants."""
        from decimal import Decimal

        out = dict(data)
        for f in self.catalog.module(module).public():
            v = out.get(f.name)
            if v is not None:
                out[f.name] = int(v) if f.kind == "i64" else Decimal(v) if f.kind == "decimal" else V.instant(V.epoch_ms(v)) if f.kind == "date" else v
        return out
