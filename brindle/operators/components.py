"""Components: JSON inside a row, walked on the page's rows only, with media and relations inside it looked up."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F

from brindle.operators.filters import Filters
from brindle.operators.visibility import visible
from brindle.plans import ir
from brindle.sources.catalog import Module

if TYPE_CHECKING:
    from brindle.engine import Engine

KINDS = ("component", "component-repeatable", "dynamiczone")


def expand_components(engine: Engine, own: Module, query: ir.Query, rows: list[str]) -> list[str]:
    """Rendered rows with the references inside populated components replaced by what they name. References to
    rows that a reader doesn't see by default become null, or leave their list. Rows without any come back as they
    are, so that their JSON stays verbatim."""
    wanted = [f for f in own.public() if f.type in KINDS and any(n.field == f.name for n in query.populate)]
    if not wanted or not rows:
        return rows
    parsed = [json.loads(r) for r in rows]
    found: dict[str, set[int]] = {}
    for r in parsed:
        for f in wanted:
            _walk(r.get(f.name), f.components, engine.components, lambda kind, v, many: (found.setdefault(kind, set()).update(x for x in (v if many else [v]) if isinstance(x, int)), v)[1])
    rows_of = {kind: _lookup(engine, kind, ids) for kind, ids in found.items()}

    def put(kind: str, v: Any, many: bool) -> Any:
        table = rows_of.get(kind, {})
        return [table[x] for x in v if x in table] if many else table.get(v)

    for r in parsed:
        for f in wanted:
            r[f.name] = _walk(r.get(f.name), f.components, engine.components, put)
    return [json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in parsed]


def _walk(value: Any, components: tuple[str, ...], known: dict[str, Module], at: Any) -> Any:
    """The value with at(kind, reference, many) in place of each reference; kind is "files" or a module's name."""
    if isinstance(value, list):
        return [_walk(v, components, known, at) for v in value]
    if not isinstance(value, dict):
        return value
    name = value.get("__component") or (components[0] if len(components) == 1 else None)
    component, out = known.get(name), dict(value)
    if component is None:
        return out
    for f in component.fields:
        if f.name not in out:
            continue
        if f.type == "media" and out[f.name] is not None:
            out[f.name] = at("files", out[f.name], f.multiple)
        elif f.type in KINDS:
            out[f.name] = _walk(out[f.name], f.components, known, at)
    for r in component.relations:
        if out.get(r.name) is not None:
            out[r.name] = at(r.target, out[r.name], not r.to_one)
    return out


def _lookup(engine: Engine, kind: str, ids: set[int]) -> dict[int, dict]:
    """The page's references only: a bounded number of ids."""
    if kind == "files":
        if engine.catalog.files is None:
            return {}
        rows = engine.catalog.files.filter(F.col("id").isin(sorted(ids))).collect() if ids else []
        return {r["id"]: r.asDict(recursive=True) for r in rows}
    module = engine.catalog.module(kind)
    where = ir.all_of(ir.Leaf(module.id_field.name, "in", tuple(sorted(ids))), visible(module, None, None, engine.default_locale))
    page = Filters(engine.catalog).apply(engine.catalog.rows[kind], kind, where)
    return {int((d := json.loads(text))[module.id_field.name]): d for text in engine._rendered(page, module, ir.Query())}
