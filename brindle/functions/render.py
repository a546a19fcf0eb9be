"""Rows as the wire's JSON: 64-bit integers and decimals are strings, instants ISO 8601, json fields verbatim."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Row

from brindle.functions import values as V
from brindle.sources.catalog import Field


def value(field: Field | None, v: Any) -> str:
    if v is None:
        return "null"
    kind = field.kind if field else None
    if isinstance(v, Row):
        return json.dumps(v.asDict(recursive=True), ensure_ascii=False, separators=(",", ":"), default=str)
    if isinstance(v, list):
        return "[" + ",".join(value(None, x) for x in v) + "]"
    if kind == "json" and isinstance(v, str):
        return v
    if kind == "i64":
        return f'"{v}"'
    if kind == "decimal":
        return f'"{V.render_decimal(v, field.scale or 0)}"'
    if kind == "date" or hasattr(v, "isoformat"):
        return f'"{V.render_instant(v)}"'
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return V.render_double(v)
    return json.dumps(v, ensure_ascii=False)


def row(fields: list[Field], nested: dict[str, Any], r: Row) -> str:
    """fields in order, then relations; nested has for each relation (fields, nested) of its target."""
    parts = [f"{json.dumps(f.name)}:{value(f, r[f.name])}" for f in fields]
    for name, plan in nested.items():
        v = r[name]
        if plan is None:
            parts.append(f"{json.dumps(name)}:{value(None, v)}")
        elif isinstance(v, list):
            parts.append(f"{json.dumps(name)}:[{','.join(row(*plan, x) for x in v)}]")
        else:
            parts.append(f"{json.dumps(name)}:{'null' if v is None else row(*plan, v)}")
    return "{" + ",".join(parts) + "}"


def envelope(data: list[str] | str, meta: dict) -> str:
    body = data if isinstance(data, str) else "[" + ",".join(data) + "]"
    return f'{{"data":{body},"meta":{json.dumps(meta, separators=(",", ":"))}}}'
