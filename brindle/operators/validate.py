"""Bodies of writes: unknown fields, missing ones, types, bounds, components; and the same as expressions for bulk rows."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import values as V
from brindle.operators.components import KINDS
from brindle.operators.filters import column, literal
from brindle.sources.catalog import SYSTEM, Field, Module, Side

DEPTH, COMPONENT_BYTES = 10, 256 * 1024
_EMAIL = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


class BodyError(ValueError):
    code, status = "body_invalid", 400


def bound(raw: Any, field: Field, now: datetime) -> Any:
    """A minimum or maximum: a number, or for dates also one relative to now. Calendar dates compare by day."""
    if field.kind != "date":
        return raw
    ms = V.epoch_ms(V.now_shifted(raw, now)) if isinstance(raw, str) and raw.startswith("$now") else V.epoch_ms(raw)
    return ms // 86_400_000 if field.type == "date" else ms


def coerce(field: Field, value: Any, components: dict[str, Module], now: datetime) -> Any:
    """The value as its column has it, or BodyError."""

    def fail(why: str) -> None:
        raise BodyError(f'field "{field.name}": {why}')

    if value is None:
        if not field.nullable:
            fail("must not be null")
        return None
    kind, comparable = field.kind, value
    try:
        if field.type == "media":
            ids = value if field.multiple else [value]
            if not isinstance(ids, list) or any(isinstance(i, bool) or not isinstance(i, int) for i in ids):
                fail("asset ids are expected")
            _sized(field, ids, fail)
            return json.dumps(ids) if field.multiple else value
        if kind == "i32" or kind == "f64":
            if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or kind == "i32" and (value != int(value) or not -(1 << 31) <= value < 1 << 31):
                fail("a number is expected" if kind == "f64" else "an integer of 32 bits is expected")
            value = int(value) if kind == "i32" else float(value)
        elif kind == "bool":
            if not isinstance(value, bool):
                fail("true or false is expected")
        elif kind == "i64":
            value = comparable = V.int64(value)
        elif kind == "decimal":
            value = comparable = V.decimal(value, field.scale or 0, field.precision)
        elif kind == "date":
            ms = V.epoch_ms(value)
            value, comparable = V.instant(ms), ms // 86_400_000 if field.type == "date" else ms
        elif kind == "json":
            return _json(field, value, components, fail)
        else:
            if not isinstance(value, str):
                fail("a string is expected")
            if field.length is not None and len(value) > field.length:
                fail(f"at most {field.length} characters")
            if field.type == "enumeration" and value not in field.values:
                fail(f"one of {', '.join(field.values)} is expected")
            if field.type == "email" and not _EMAIL.fullmatch(value) or field.type == "uuid" and not _UUID.fullmatch(value):
                fail(f"no {field.type}")
            if field.pattern is not None and not re.fullmatch(field.pattern, value):
                fail("doesn't match its pattern")
            comparable = len(value)
    except V.BadValue as e:
        fail(str(e))
    if field.min is not None and comparable < bound(field.min, field, now) or field.max is not None and comparable > bound(field.max, field, now):
        fail(f"must lie between {field.min} and {field.max}")
    return value


def _sized(field: Field, items: list, fail) -> None:
    if field.min_items is not None and len(items) < field.min_items or field.max_items is not None and len(items) > field.max_items:
        fail(f"{field.min_items} to {field.max_items} items are expected")
    if field.unique_items and len({json.dumps(i, sort_keys=True) for i in items}) < len(items):
        fail("items must differ")


def _json(field: Field, value: Any, components: dict[str, Module], fail) -> str:
    if field.type == "array":
        if not isinstance(value, list):
            fail("a list is expected")
        _sized(field, value, fail)
    if field.type in KINDS:
        many = field.type != "component"
        if isinstance(value, list) != many:
            fail("a list of components is expected" if many else "a component is expected")
        for one in value if many else [value]:
            if len(json.dumps(one).encode()) > COMPONENT_BYTES:
                fail("a component is too large")
        value = _components(field, value, components, 1, fail)
    try:
        text = json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        text.encode()
    except (ValueError, TypeError) as e:
        fail(f"no JSON: {e}")
    return text


def _components(field: Field, value: Any, components: dict[str, Module], depth: int, fail) -> Any:
    if depth > DEPTH:
        fail(f"components nested deeper than {DEPTH} levels")
    if isinstance(value, list):
        _sized(field, value, fail)
        return [_components(field, v, components, depth, fail) for v in value]
    if not isinstance(value, Mapping):
        fail("a component is expected")
    name = value.get("__component") if field.type == "dynamiczone" else field.components[0]
    if name not in field.components or name not in components:
        fail(f'component "{name}" is not allowed')
    known, now, out = components[name], datetime.now(UTC), {}
    names = {f.name: f for f in known.fields}
    for key, v in value.items():
        if key in ("id", "__component") or any(r.name == key for r in known.relations):
            out[key] = v
        elif key not in names:
            fail(f'component "{name}" has no field "{key}"')
        elif names[key].type in KINDS and v is not None:
            out[key] = _components(names[key], v, components, depth + 1, fail)
        else:
            stored = coerce(names[key], v, components, now)
            out[key] = v if names[key].kind in ("json", "date", "decimal", "i64") else stored
    if missing := [f.name for f in known.fields if not f.nullable and out.get(f.name) is None and f.default is None]:
        fail(f'component "{name}" needs "{missing[0]}"')
    return out


def body(module: Module, data: Any, sides: dict[str, Side], create: bool, components: dict[str, Module] | None = None, now: datetime | None = None) -> tuple[dict[str, Any], dict[str, Any]]:
    """(columns, relation operations) of a body. System fields can't be written; a create needs all that has no
    default and can't be null; an update needs something."""
    now = now or datetime.now(UTC)
    if not isinstance(data, Mapping):
        raise BodyError("an object is expected")
    fields, columns, relations = {f.name: f for f in module.fields}, {}, {}
    for key, value in data.items():
        if key in sides:
            relations[key] = value
        elif key in fields:
            columns[key] = coerce(fields[key], value, components or {}, now)
        else:
            raise BodyError(f'"{key}" can\'t be written' if key in SYSTEM else f'unknown field "{key}"')
    if create:
        for f in module.fields:
            if f.name not in columns:
                if f.default is None and not f.nullable:
                    raise BodyError(f'field "{f.name}" is required')
                columns[f.name] = None if f.default is None else coerce(f, f.default, components or {}, now)
    elif not columns and not relations:
        raise BodyError("nothing to update")
    return columns, relations


def relation_operation(side: Side, name: str, raw: Any) -> dict[str, list[int]]:
    """set, connect and disconnect lists of ids; a bare id, list or null is a set. set stands alone."""
    if raw is None or isinstance(raw, int | list):
        raw = {"set": [] if raw is None else raw}
    if not isinstance(raw, Mapping) or not raw or set(raw) - {"set", "connect", "disconnect"} or "set" in raw and len(raw) > 1:
        raise BodyError(f'relation "{name}": set, or connect and disconnect, are expected')
    out = {}
    for op, ids in raw.items():
        ids = ids if isinstance(ids, list) else [] if ids is None else [ids]
        ids = [i["id"] if isinstance(i, Mapping) and set(i) == {"id"} else i for i in ids]
        if any(isinstance(i, bool) or not isinstance(i, int) or i < 1 for i in ids) or len(set(ids)) < len(ids):
            raise BodyError(f'relation "{name}": different ids are expected')
        if side.to_one and op != "disconnect" and len(ids) > 1:
            raise BodyError(f'relation "{name}" takes one row')
        out[op] = ids
    return out


# -- bulk ------------------------------------------------------------------------


def violations(module: Module) -> Column:
    """An array of what is wrong with a row, in expressions; empty if nothing is."""
    found: list[Column] = []

    def note(f: Field, wrong: Column, why: str) -> None:
        found.append(F.when(F.coalesce(wrong, F.lit(False)), F.lit(f"{f.name}: {why}")))

    for f in module.fields:
        c = column(f.name)
        if not f.nullable:
            note(f, c.isNull(), "null")
        if f.kind in ("string", "text"):
            if f.length is not None:
                note(f, F.char_length(c) > f.length, "too long")
            if f.type == "enumeration":
                note(f, ~c.isin(*f.values), "not a member")
            if f.pattern is not None:
                note(f, ~c.rlike(f"^(?:{f.pattern})$"), "pattern")
            if f.type == "email":
                note(f, ~c.rlike(f"^(?:{_EMAIL.pattern})$"), "no email")
            size = F.char_length(c)
        elif f.kind in ("json", "bool"):
            continue
        else:
            size = c
        if f.kind == "f64":
            note(f, F.isnan(c) | c.isin(math.inf, -math.inf), "not finite")
        for limit, wrong in ((f.min, size.__lt__), (f.max, size.__gt__)):
            if limit is not None:
                at = F.lit(V.instant(V.epoch_ms(limit))).cast("timestamp_ntz") if f.kind == "date" else F.lit(limit) if f.kind in ("string", "text") else literal(f, limit)
                note(f, wrong(at), "out of bounds")
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def split_valid(rows: DataFrame, module: Module) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with violations and what they are in column errors)."""
    checked = rows.withColumn("errors", violations(module))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
