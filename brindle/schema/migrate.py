"""Rows follow their module's definition: checks first, then one projection per module."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import stats
from brindle.operators.filters import column
from brindle.schema.diff import DATA, DESTRUCTIVE, FORBIDDEN, SAFE, Change, diff
from brindle.sources.catalog import Catalog, Field, Module, SchemaError
from brindle.sources.store import Store, module_json


class Refused(SchemaError):
    code = "migration_refused"


def converted(old: Field, new: Field) -> Column:
    """Values as the new type has them, null where they can't be."""
    c = column(old.name)
    if (old.kind, new.kind) == ("date", "string"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if old.kind == "bool" and new.kind == "string" or old.kind == new.kind and old.kind != "decimal":
        return c.cast(new.spark)
    return c.try_cast(new.spark)


def obstacles(rows: DataFrame, change: Change) -> int:
    """How many rows a data-dependent change would lose or break."""
    if change.kind == "addField":
        return rows.count()
    if change.kind == "setFieldNullable":
        return stats.nulls(rows, change.name).first()["n"]
    old, new = change.old, change.new
    now = column(old.name)
    lost = now.isNotNull() & converted(old, new).isNull()
    if new.kind in ("string", "text") and new.length is not None:
        lost = lost | (F.char_length(converted(old, new)) > new.length)
    if new.type == "enumeration":
        lost = lost | ~converted(old, new).isin(*new.values)
    if old.kind in ("decimal", "f64") and new.kind in ("decimal", "i32", "i64"):
        scale = (new.scale or 0) if new.kind == "decimal" else 0
        lost = lost | (now != F.round(now, scale))
    return rows.filter(F.coalesce(lost, F.lit(False))).count()


def reshaped(rows: DataFrame, old: Module, new: Module) -> DataFrame:
    """One projection: renamed (also in a swap), retyped, dropped, added with their defaults, in the new order."""
    by_id = {f.id or f.name: f for f in old.fields}
    own = {f.name for f in old.columns()}
    out = []
    for f in new.columns():
        before = by_id.get(f.id or f.name) if f in new.fields else f if f.name in own else None
        value = converted(before, f) if before is not None else F.lit(f.default).cast(f.spark)
        out.append(value.alias(f.name))
    return rows.select(*out)


def plan(catalog: Catalog, new: Iterable[Module], allow_destructive: bool = False) -> list[Change]:
    """What would change; Refused if something is forbidden, or destroys data without leave."""
    changes = diff(catalog.modules.values(), [m.checked() for m in new])
    if bad := [c for c in changes if c.risk == FORBIDDEN or c.risk == DESTRUCTIVE and not allow_destructive]:
        raise Refused(", ".join(f"{c.kind} {c.module} {c.name or ''}".strip() + f" is {c.risk}" for c in bad))
    return changes


def migrate(store: Store, catalog: Catalog, new: Iterable[Module], allow_destructive: bool = False, expected_version: int | None = None) -> list[Change]:
    """Brings store and catalog to the new modules, in one commit. Nothing to change writes nothing. expected_version is
    the manifest's as the caller knew it: another one refuses."""
    new = [m.checked() for m in new]
    spark, kept = store.spark, {m.id or m.name for m in new}
    with store.writing(catalog) as draft:
        # nobody else writes from here on: what the checks find still holds at the commit
        changes = plan(catalog, new, allow_destructive)
        if expected_version is not None and expected_version != store.manifest["version"]:
            raise Refused(f"version {expected_version} is not the current one")
        if not changes:
            return changes
        by_id = {m.id or m.name: m for m in catalog.modules.values()}
        for change in changes:
            if change.risk == DATA:
                old = by_id[next(m.id or m.name for m in new if m.name == change.module)]
                if n := obstacles(catalog.rows[old.name], change):
                    raise Refused(f"{change.kind} {change.module}.{change.name}: {n} rows stand against it")
        touched = {c.module for c in changes if c.risk in (SAFE, DATA, DESTRUCTIVE)}
        before = (dict(catalog.modules), dict(catalog.rows), dict(catalog.links), dict(catalog.versions))
        try:
            for name in [m.name for k, m in by_id.items() if k not in kept]:
                catalog.drop(name)
            for module in new:
                old = by_id.get(module.id or module.name)
                if old is not None and old.name != module.name:
                    catalog.rename(old.name, module.name)
                rows = spark.createDataFrame([], module.schema()) if old is None else catalog.rows[module.name]
                if old is None or module.name in touched:
                    rows = rows if old is None else reshaped(rows, old, module)
                    draft["rows"][module.name], rows = store.put(module.name, rows)
                links = {}
                for r in module.relations:
                    was = next((x for x in old.relations if (x.id or x.name) == (r.id or r.name) and x.kind == r.kind), None) if old else None
                    link = catalog.links.get(f"{module.name}.{was.name}") if was else None
                    if r.column is None and (link is None or was.name != r.name):
                        _, link = store.put(f"{module.name}.{r.name}", link if link is not None else spark.createDataFrame([], "id long, owner_id long, related_id long"))
                    if link is not None:
                        links[r.name] = link
                catalog.register(module, rows, links)
                for key in [k for k in catalog.links if k.startswith(f"{module.name}.") and k.split(".", 1)[1] not in links]:
                    del catalog.links[key]
            draft["modules"] = {m.name: module_json(m) for m in new}
            draft["rows"] = {m.name: draft["rows"].get(m.name) or catalog.rows[m.name].folder for m in new} | {k: v for k, v in draft["rows"].items() if k == "files"}
            draft["links"] = {k: v.folder for k, v in catalog.links.items()}
            draft["versions"] = catalog.versions
            names = {(m.id or m.name): m.name for m in new}
            draft["ids"] = {names[k]: draft["ids"].get(m.name, 0) for k, m in by_id.items() if k in names} | {m.name: 0 for m in new if (m.id or m.name) not in by_id}
        except BaseException:
            catalog.modules, catalog.rows, catalog.links, catalog.versions = before
            raise
    return changes
