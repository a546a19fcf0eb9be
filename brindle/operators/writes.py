"""Writes: rows and links as they are afterwards, and a writer that commits them to a store."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.functions.render import envelope
from brindle.functions.values import locale_slug, media_category
from brindle.operators.filters import column
from brindle.operators.validate import BodyError, body, relation_operation
from brindle.plans import ir
from brindle.sources.catalog import Catalog, Field, Module, Side
from brindle.sources.store import Store

# -- rows ------------------------------------------------------------------------


def inserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in rows.schema)))


def updated(rows: DataFrame, key: str, ids: list[int], values: Mapping[str, Any]) -> DataFrame:
    """One pass over the rows: each column named gets its value where the key is one of ids."""
    hit = column(key).isin(ids)
    return rows.select(*(F.when(hit, F.lit(values[f.name]).cast(f.dataType)).otherwise(column(f.name)).alias(f.name) if f.name in values else column(f.name) for f in rows.schema))


def merged(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Bulk upsert: rows whose key is in changes are replaced, others of changes added. Of several changes to a key the
    caller has kept one."""
    return rows.join(changes.select(column(key)), key, "left_anti").unionByName(changes.select(*map(column, rows.columns)))


def deleted(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """gone: a column id."""
    return rows.join(gone.select(F.col("id").alias("_gone")), column(key) == F.col("_gone"), "left_anti")


def unlinked(links: DataFrame, end: str, gone: DataFrame) -> DataFrame:
    return links.join(gone.select(F.col("id").alias("_gone")), F.col(end) == F.col("_gone"), "left_anti")


def fanned_out(rows: DataFrame, document: int, values: Mapping[str, Any]) -> DataFrame:
    """Fields that all locales of a document share."""
    return updated(rows, "document_id", [document], values)


# -- links ------------------------------------------------------------------------


def connected(links: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """links with the edges of new (owner_id, related_id, in order of id) as the kind allows: an end that has room for one
    edge keeps its newest, and a pair stands once, where it stood first."""
    highest = links.agg(F.max("id")).first()[0] or 0
    added = new.select((F.col("id") + F.lit(highest)).alias("id"), "owner_id", "related_id")
    edges = links.select("id", "owner_id", "related_id").unionByName(added)
    edges = edges.groupBy("owner_id", "related_id").agg(F.min("id").alias("id"), F.max("id").alias("newest"))
    for end in {"oneToOne": ("owner_id", "related_id"), "manyToOne": ("owner_id",), "oneToMany": ("related_id",), "manyToMany": ()}[kind]:
        edges = edges.withColumn("_rank", F.row_number().over(Window.partitionBy(end).orderBy(F.col("newest").desc()))).filter("_rank = 1").drop("_rank")
    return edges.select("id", "owner_id", "related_id")


def disconnected(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select("owner_id", "related_id"), ["owner_id", "related_id"], "left_anti").select("id", "owner_id", "related_id")


def relinked(links: DataFrame, side: Side, row_id: int, operation: Mapping[str, list[int]]) -> DataFrame:
    """What a body's operation on one row's relation makes of the links; from either end."""
    spark = links.sparkSession

    def edges(ids: list[int]) -> DataFrame:
        ends = [(row_id, i) if side.here == "owner_id" else (i, row_id) for i in ids]
        return spark.createDataFrame([(n + 1, o, r) for n, (o, r) in enumerate(ends)], "id long, owner_id long, related_id long")

    if "set" in operation:
        links = links.filter(F.col(side.here) != row_id)
    if operation.get("disconnect"):
        links = disconnected(links, edges(operation["disconnect"]))
    new = operation.get("set") or operation.get("connect")
    return connected(links, edges(new), side.relation.kind) if new else links


# -- what a write must not break ---------------------------------------------------


def dangling(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Ids (column id) of no row."""
    return ids.join(rows.select(column(key).alias("_there")), F.col("id") == F.col("_there"), "left_anti")


class ConstraintError(ValueError):
    code, status = "constraint", 400


class Writer:
    """Creates, updates, deletes and publishes single rows of a stored catalog, one commit each.

    hooks: functions by (module, moment), where moment is before or after and create, update or delete. One before may
    return another body, or raise to veto; what one after raises is swallowed, for the write has happened.
    """

    def __init__(self, store: Store, engine: Engine, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.store, self.engine, self.clock = store, engine, clock
        self.hooks: dict[tuple[str, str], Callable[[Any], Any]] = {}

    @property
    def catalog(self) -> Catalog:
        return self.engine.catalog

    def _now(self) -> datetime:
        now = self.clock().astimezone(UTC).replace(tzinfo=None)
        return now.replace(microsecond=now.microsecond // 1000 * 1000)

    def _before(self, module: str, what: str, data: Any) -> Any:
        hook = self.hooks.get((module, f"before {what}"))
        changed = hook(data) if hook else None
        return data if changed is None else changed

    def _after(self, module: str, what: str, result: Any) -> None:
        if hook := self.hooks.get((module, f"after {what}")):
            with contextlib.suppress(Exception):
                hook(result)

    def _one(self, module: Module, row_id: int) -> dict[str, Any]:
        found = self.catalog.rows[module.name].filter(column(module.id_field.name) == row_id).limit(1).collect()
        if not found:
            raise ir.NotFound(f'no "{module.name}" {row_id}')
        return found[0].asDict()

    def _check(self, module: Module, values: Mapping[str, Any], row_id: int | None, siblings: int | None = None) -> None:
        """Unique fields and assets; one job each, over two columns. Locales of one document may agree."""
        rows, own = self.catalog.rows[module.name], module.id_field.name
        for f in module.fields:
            v = values.get(f.name)
            if v is None:
                continue
            if f.unique:
                same = rows.filter(column(f.name) == F.lit(v).cast(f.spark))
                same = same if row_id is None else same.filter(column(own) != row_id)
                same = same if siblings is None else same.filter(F.col("document_id") != siblings)
                if not same.isEmpty():
                    raise ConstraintError(f'field "{f.name}": {v} is taken')
            if f.type == "media":
                self._assets(f, v)

    def _assets(self, f: Field, v: Any) -> None:
        ids = json.loads(v) if f.multiple else [v]
        known = {r["id"]: r["mime"] for r in self.catalog.files.filter(F.col("id").isin(ids)).select("id", "mime").collect()} if self.catalog.files is not None and ids else {}
        if missing := [i for i in ids if i not in known]:
            raise ConstraintError(f'field "{f.name}": no assets {missing}')
        if f.allowed_types and (bad := [i for i in ids if media_category(known[i]) not in f.allowed_types]):
            raise ConstraintError(f'field "{f.name}": assets {bad} are of no type allowed')

    def _put_rows(self, draft: dict, module: Module, rows: DataFrame) -> None:
        draft["rows"][module.name], self.catalog.rows[module.name] = self.store.put(module.name, rows)

    def _put_links(self, draft: dict, key: str, links: DataFrame) -> None:
        draft["links"][key], self.catalog.links[key] = self.store.put(key, links)

    def _relate(self, draft: dict, module: Module, row_id: int, operations: Mapping[str, Any]) -> None:
        sides = self.catalog.sides(module.name)
        for name, raw in operations.items():
            side, operation = sides[name], relation_operation(sides[name], name, raw)
            ids = sorted({i for k in ("set", "connect") for i in operation.get(k, [])})
            if ids:
                wanted = self.store.spark.createDataFrame([(i,) for i in ids], "id long")
                missing = [r["id"] for r in dangling(wanted, self.catalog.rows[side.target], self.catalog.module(side.target).id_field.name).collect()]
                if missing:
                    raise ConstraintError(f'relation "{name}": no "{side.target}" {missing}')
            self._put_links(draft, side.link, relinked(self.catalog.links[side.link], side, row_id, operation))

    @contextlib.contextmanager
    def _commit(self, module: str):
        """What others have committed is read first: a write adds to it. The body was checked by the module's definition, so
        a definition changed meanwhile is a Conflict. The catalog goes back to what it was if the commit fails."""
        known, before = self.catalog.module(module), None
        try:
            with self.store.writing(self.catalog) as draft:
                before = (dict(self.catalog.rows), dict(self.catalog.links))
                if self.catalog.modules.get(module) != known:
                    raise ir.Conflict(f'the definition of "{module}" has changed')
                yield draft
        except BaseException:
            if before:
                self.catalog.rows, self.catalog.links = before
            raise
        self.engine.changed(module)

    def create(self, name: str, data: Any, locale: str | None = None) -> str:
        module = self.catalog.module(name)
        columns, relations = body(module, self._before(name, "create", data), self.catalog.sides(name), True, self.engine.components, self.clock())
        with self._commit(name) as draft:
            if module.single and not self.catalog.rows[name].isEmpty():
                raise ir.Conflict(f'"{name}" has its one row')
            self._check(module, columns, None)
            row_id = self._insert(draft, module, columns, None, locale)
            self._relate(draft, module, row_id, relations)
        return self._answer(name, row_id, "create")

    def _insert(self, draft: dict, module: Module, columns: Mapping[str, Any], document: int | None, locale: str | None) -> int:
        row_id = draft["ids"].get(module.name, 0) + 1
        draft["ids"][module.name] = row_id
        now = self._now()
        system = {module.id_field.name: row_id, "created_at": now, "updated_at": now, "document_id": document or row_id, "published_at": None, "locale": locale or self.engine.default_locale}
        values = {**columns, **{f.name: system[f.name] for f in module.columns() if f.name in system}}
        schema = module.schema()
        row = self.store.spark.createDataFrame([tuple(values[f.name] for f in module.columns())], schema)
        self._put_rows(draft, module, inserted(self.catalog.rows[module.name], row))
        return row_id

    def update(self, name: str, row_id: int, data: Any) -> str:
        module = self.catalog.module(name)
        columns, relations = body(module, self._before(name, "update", data), self.catalog.sides(name), False, self.engine.components, self.clock())
        with self._commit(name) as draft:
            old = self._one(module, row_id)
            self._check(module, columns, row_id, old.get("document_id"))
            rows = updated(self.catalog.rows[name], module.id_field.name, [row_id], {**columns, "updated_at": self._now()})
            shared = {f.name: columns[f.name] for f in module.fields if f.name in columns and not f.localized}
            if module.i18n and shared:
                rows = fanned_out(rows, old["document_id"], shared)
            self._put_rows(draft, module, rows)
            self._relate(draft, module, row_id, relations)
        return self._answer(name, row_id, "update")

    def delete(self, name: str, row_id: int) -> None:
        module = self.catalog.module(name)
        self._before(name, "delete", row_id)
        with self._commit(name) as draft:
            self._one(module, row_id)
            gone = self.store.spark.createDataFrame([(row_id,)], "id long")
            self._put_rows(draft, module, deleted(self.catalog.rows[name], module.id_field.name, gone))
            for other in self.catalog.modules.values():
                for r in other.relations:
                    key, ends = f"{other.name}.{r.name}", [e for e, of in (("owner_id", other.name), ("related_id", r.target)) if of == name]
                    if ends and key in self.catalog.links:
                        links = self.catalog.links[key]
                        for end in ends:
                            links = unlinked(links, end, gone)
                        self._put_links(draft, key, links)
        self._after(name, "delete", row_id)

    def publish(self, name: str, row_id: int) -> str:
        return self._publish(name, row_id, self._now())

    def unpublish(self, name: str, row_id: int) -> str:
        return self._publish(name, row_id, None)

    def _publish(self, name: str, row_id: int, at: datetime | None) -> str:
        module = self.catalog.module(name)
        if not module.draft_and_publish:
            raise BodyError(f'"{name}" has no drafts')
        with self._commit(name) as draft:
            self._one(module, row_id)
            self._put_rows(draft, module, updated(self.catalog.rows[name], module.id_field.name, [row_id], {"published_at": at, "updated_at": self._now()}))
        return self._answer(name, row_id, "update")

    def create_variant(self, name: str, row_id: int, locale: str, data: Any) -> str:
        """The row in another locale: shared fields are copied, localized ones are those of data or their defaults."""
        module = self.catalog.module(name)
        if not module.i18n:
            raise BodyError(f'"{name}" has no locales')
        locale_slug(locale)
        columns, relations = body(module, self._before(name, "create", data), self.catalog.sides(name), True, self.engine.components, self.clock())
        with self._commit(name) as draft:
            old = self._one(module, row_id)
            document = old["document_id"]
            if not self.catalog.rows[name].filter((F.col("document_id") == document) & (F.col("locale") == locale)).isEmpty():
                raise ir.Conflict(f'document {document} is there in "{locale}"')
            columns |= {f.name: old[f.name] for f in module.fields if not f.localized}
            self._check(module, columns, None, document)
            new = self._insert(draft, module, columns, document, locale)
            self._relate(draft, module, new, relations)
        return self._answer(name, new, "create")

    def _answer(self, name: str, row_id: int, what: str) -> str:
        """As a read renders it, whether a reader would see it or not."""
        module = self.catalog.module(name)
        rows = self.catalog.rows[name].filter(column(module.id_field.name) == row_id)
        text = envelope(self.engine._rendered(rows, module, ir.Query())[0], {})
        self._after(name, what, text)
        return text
