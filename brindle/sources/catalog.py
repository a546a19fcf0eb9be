"""Modules (content types): their fields, options and relations, and the types that each field has in Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.plans.ir import NotFound

#: Declared field types and the column type that each is kept as.
FIELD_TYPES = {
    "string": "string", "email": "string", "uid": "string", "uuid": "string", "enumeration": "string", "text": "text",
    "integer": "i32", "biginteger": "i64", "float": "f64", "decimal": "decimal", "boolean": "bool", "date": "date", "datetime": "date",
    "json": "json", "array": "json", "media": "i32", "component": "json", "component-repeatable": "json", "dynamiczone": "json",
}
RELATION_KINDS = ("oneToOne", "oneToMany", "manyToOne", "manyToMany")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")
SYSTEM = ("id", "created_at", "updated_at", "document_id", "published_at", "locale")


class SchemaError(ValueError):
    code, status = "schema_invalid", 400


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name) or len(name.encode()) > 63:
        raise SchemaError(f'"{name}" is no name: letters, digits, _ and $, not a digit first, up to 63 bytes')
    return name


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    nullable: bool = True
    private: bool = False
    unique: bool = False
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    values: tuple[str, ...] = ()
    default: Any = None
    min: Any = None
    max: Any = None
    min_items: int | None = None
    max_items: int | None = None
    unique_items: bool = False
    pattern: str | None = None
    multiple: bool = False
    allowed_types: tuple[str, ...] = ()
    components: tuple[str, ...] = ()
    localized: bool = True
    id: str | None = None

    @property
    def kind(self) -> str:
        """i32, f64, bool, string, text, date, i64, decimal or json."""
        if self.type == "media" and self.multiple:
            return "json"
        if self.type not in FIELD_TYPES:
            raise SchemaError(f'field "{self.name}": type "{self.type}" is not supported')
        return FIELD_TYPES[self.type]

    @property
    def spark(self) -> T.DataType:
        simple = {"i32": T.IntegerType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "i64": T.LongType(), "date": T.TimestampNTZType()}
        return T.DecimalType(self.precision or 18, self.scale or 0) if self.kind == "decimal" else simple.get(self.kind, T.StringType())

    def checked(self) -> Field:
        check_name(self.name)
        if self.kind == "decimal" and not 0 <= (self.scale or 0) <= 18:
            raise SchemaError(f'field "{self.name}": a decimal has 0 to 18 fraction digits')
        if self.unique and (self.kind in ("text", "bool", "json") or self.type == "media"):
            raise SchemaError(f'field "{self.name}": {self.type} can\'t be unique')
        if self.type == "enumeration" and not self.values:
            raise SchemaError(f'field "{self.name}": an enumeration has values')
        return self


@dataclass(frozen=True)
class Relation:
    """A field of its module that names rows of another. The link table has owner_id, related_id and its own id."""

    name: str
    target: str
    kind: str = "manyToOne"
    inverse: str | None = None  # the name it has on the target's side, if it can be followed from there
    column: str | None = None  # of to-one relations that the owner's rows hold themselves: no link table
    id: str | None = None

    @property
    def to_one(self) -> bool:
        return self.kind in ("oneToOne", "manyToOne")


@dataclass(frozen=True)
class Side:
    """A relation as it is seen from one of its ends."""

    relation: Relation
    owner: str
    target: str
    link: str
    to_one: bool
    here: str = "owner_id"
    there: str = "related_id"


@dataclass(frozen=True)
class Module:
    name: str
    fields: tuple[Field, ...] = ()
    relations: tuple[Relation, ...] = ()
    draft_and_publish: bool = False
    i18n: bool = False
    single: bool = False
    id_field: Field = Field("id", "integer", nullable=False)
    bare: bool = False  # a table that has no system columns but its id
    id: str | None = None

    def columns(self) -> tuple[Field, ...]:
        """System fields first: their order is that of the wire."""
        at = (Field("created_at", "datetime", nullable=False), Field("updated_at", "datetime", nullable=False))
        head = (self.id_field,) if self.bare else (self.id_field, *at)
        if self.i18n:
            head += (Field("document_id", "integer", nullable=False),)
        if self.draft_and_publish:
            head += (Field("published_at", "datetime"),)
        if self.i18n:
            head += (Field("locale", "string", nullable=False, length=35),)
        return head + self.fields

    def column(self, name: str) -> Field | None:
        return next((f for f in self.columns() if f.name == name), None)

    def public(self) -> tuple[Field, ...]:
        return tuple(f for f in self.columns() if not f.private)

    def checked(self) -> Module:
        check_name(self.name)
        names = [*(f.checked().name for f in self.columns()), *(check_name(r.name) for r in self.relations)]
        if twice := {n for n in names if names.count(n) > 1}:
            raise SchemaError(f'module "{self.name}" has {", ".join(sorted(twice))} twice')
        reserved = set() if self.bare else {f.name for f in self.fields} & set(SYSTEM)
        if reserved:
            raise SchemaError(f'module "{self.name}": {", ".join(sorted(reserved))} is a system field')
        if bad := [r.name for r in self.relations if r.kind not in RELATION_KINDS]:
            raise SchemaError(f'module "{self.name}": relation {bad[0]} has no known kind')
        return self

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark, f.nullable, {"cms": f.kind}) for f in self.columns()])


@dataclass
class Catalog:
    """Modules and the DataFrames of their rows and links. versions rise where a module's columns change; stored is the
    version of the manifest that the rows are from."""

    modules: dict[str, Module] = field(default_factory=dict)
    rows: dict[str, DataFrame] = field(default_factory=dict)
    links: dict[str, DataFrame] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)
    files: DataFrame | None = None
    stored: int = 0

    def become(self, other: Catalog) -> None:
        """Takes over all that the other holds."""
        self.__dict__.update(vars(other))

    def register(self, module: Module, rows: DataFrame, links: dict[str, DataFrame] | None = None) -> Module:
        """links: a DataFrame of id, owner_id, related_id by relation name."""
        module = module.checked()
        old = self.modules.get(module.name)
        shape = lambda m: [(f.name, f.kind, f.scale, f.precision) for f in m.columns()]
        if old is None or shape(old) != shape(module):
            self.versions[module.name] = self.versions.get(module.name, 0) + 1
        self.modules[module.name] = module
        self.rows[module.name] = rows
        for name, link in (links or {}).items():
            self.links[f"{module.name}.{name}"] = link
        return module

    def drop(self, name: str) -> None:
        """Its version number stays, so that cursors of a later module of this name don't pass as its own."""
        self.module(name)
        del self.modules[name], self.rows[name]
        for key in [k for k in self.links if k.startswith(f"{name}.")]:
            del self.links[key]

    def rename(self, old: str, new: str) -> None:
        module = self.module(old)
        rows, links = self.rows[old], {r.name: self.links.get(f"{old}.{r.name}") for r in module.relations}
        self.drop(old)
        for other in list(self.modules.values()):
            if any(r.target == old for r in other.relations):
                self.modules[other.name] = replace(other, relations=tuple(replace(r, target=new if r.target == old else r.target) for r in other.relations))
        self.register(replace(module, name=new), rows, {k: v for k, v in links.items() if v is not None})

    def module(self, name: str) -> Module:
        if name not in self.modules:
            raise NotFound(f'no module "{name}"')
        return self.modules[name]

    def sides(self, name: str) -> dict[str, Side]:
        """Relations that can be followed from a module, its own and the inverse ends of others'."""
        out = {r.name: Side(r, name, r.target, f"{name}.{r.name}", r.to_one) for r in self.module(name).relations}
        for other in self.modules.values():
            for r in other.relations:
                if r.target == name and r.inverse:
                    out.setdefault(r.inverse, Side(r, name, other.name, f"{other.name}.{r.name}", r.kind in ("oneToOne", "oneToMany"), "related_id", "owner_id"))
        return out
