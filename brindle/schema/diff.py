"""Differences of module definitions, by identity: what has the same id was renamed, not dropped and added."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from brindle.sources.catalog import Field, Module, Relation

SAFE, DATA, DESTRUCTIVE, FORBIDDEN = "safe", "data-dependent", "destructive", "forbidden"
#: Changes of a column's kind that keep every value, and those that keep values only if they fit: fixed rules.
WIDER = {("i32", "i64"), ("i32", "f64"), ("i32", "decimal"), ("i64", "decimal"), ("string", "text"), ("i32", "string"), ("i64", "string"), ("i32", "text"), ("i64", "text"), ("bool", "string"), ("decimal", "string"), ("decimal", "text")}
NARROWER = {("i64", "i32"), ("text", "string"), ("f64", "decimal"), ("decimal", "f64"), ("decimal", "i32"), ("decimal", "i64"), ("f64", "i32"), ("f64", "i64"), ("string", "i32"), ("string", "i64"), ("string", "f64"), ("string", "decimal"), ("string", "date"), ("date", "string"), ("string", "bool")}


@dataclass(frozen=True)
class Change:
    kind: str
    module: str
    risk: str
    name: str | None = None
    old: Any = None
    new: Any = None


def identity(x: Module | Field | Relation) -> str:
    return x.id or x.name


def retype_risk(old: Field, new: Field) -> str:
    pair = old.kind, new.kind
    if pair[0] == pair[1]:
        if old.kind == "decimal":
            roomier = (new.scale or 0) >= (old.scale or 0) and (new.precision or 18) - (new.scale or 0) >= (old.precision or 18) - (old.scale or 0)
            return SAFE if roomier else DATA
        shorter = new.length is not None and (old.length is None or new.length < old.length)
        fewer = new.type == "enumeration" and (old.type != "enumeration" or not set(old.values) <= set(new.values))
        return DATA if shorter or fewer else SAFE
    return SAFE if pair in WIDER else DATA if pair in NARROWER else FORBIDDEN


def _matched(old: Iterable, new: Iterable) -> tuple[list, list, list]:
    before, after = {identity(x): x for x in old}, {identity(x): x for x in new}
    return [before[k] for k in before if k not in after], [after[k] for k in after if k not in before], [(before[k], after[k]) for k in after if k in before]


def _shape(f: Field) -> tuple:
    return f.type, f.kind, f.length, f.precision, f.scale, f.values, f.multiple


def diff(old: Iterable[Module], new: Iterable[Module]) -> list[Change]:
    out: list[Change] = []
    dropped, added, both = _matched(old, new)
    out += [Change("dropType", m.name, DESTRUCTIVE, old=m) for m in dropped]
    out += [Change("addType", m.name, SAFE, new=m) for m in added]
    for a, b in both:
        if a.name != b.name:
            out.append(Change("renameType", a.name, SAFE, old=a.name, new=b.name))
        gone, come, kept = _matched(a.fields, b.fields)
        out += [Change("dropField", b.name, DESTRUCTIVE, f.name, f) for f in gone]
        out += [Change("renameField", b.name, SAFE, g.name, f.name, g.name) for f, g in kept if f.name != g.name]
        out += [Change("retypeField", b.name, retype_risk(f, g), g.name, f, g) for f, g in kept if _shape(f) != _shape(g)]
        out += [Change("setFieldNullable", b.name, SAFE if g.nullable else DATA, g.name, f.nullable, g.nullable) for f, g in kept if f.nullable != g.nullable]
        out += [Change("addField", b.name, SAFE if f.nullable or f.default is not None else DATA, f.name, new=f) for f in come]
        order = [identity(f) for f in a.fields if f not in gone]
        if order != [identity(f) for f in b.fields if f not in come]:
            out.append(Change("reorderFields", b.name, SAFE, new=tuple(f.name for f in b.fields)))
        gone_r, come_r, kept_r = _matched(a.relations, b.relations)
        changed = [(r, s) for r, s in kept_r if (r.kind, r.target, r.column) != (s.kind, s.target, s.column)]
        out += [Change("dropRelation", b.name, DESTRUCTIVE, r.name, r) for r in [*gone_r, *(r for r, _ in changed)]]
        out += [Change("addRelation", b.name, SAFE, r.name, new=r) for r in [*come_r, *(s for _, s in changed)]]
        for option in ("draft_and_publish", "i18n", "single"):
            if getattr(a, option) != getattr(b, option):
                out.append(Change("setTypeOption", b.name, SAFE if option == "single" else FORBIDDEN, option, getattr(a, option), getattr(b, option)))
    return out
