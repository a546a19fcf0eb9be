"""Related rows as nested columns: a struct or null for relations to one, an array in edge order for those to many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.filters import column
from brindle.plans import ir
from brindle.sources.catalog import Catalog, Module, Side

DEPTH = 2
MEDIA_FIELDS = ("id", "name", "hash", "ext", "mime", "size", "url")


def resolved(catalog: Catalog, module: Module, nodes: tuple[ir.Populate, ...], depth: int = 1) -> dict[str, tuple[ir.Populate, ...]]:
    """Relations (and media fields) to expand at this level, with what to expand behind them. * names all relations;
    what is named twice is merged; what is deeper than DEPTH goes."""
    sides, out = catalog.sides(module.name), {}
    media = {f.name for f in module.public() if f.type == "media"}
    for node in nodes:
        if node.field != "*" and node.field not in sides and node.field not in media and not _component(module, node.field):
            raise ir.QueryError(f'"{node.field}" of "{module.name}" is nothing to populate')
        for name in sides if node.field == "*" else (node.field,):
            out[name] = (*out.get(name, ()), *(node.children if depth < DEPTH and node.field != "*" else ()))
    return out


def _component(module: Module, name: str) -> bool:
    return any(f.name == name and f.type in ("component", "component-repeatable", "dynamiczone") for f in module.public())


class Populator:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def expand(self, page: DataFrame, module: Module, nodes: tuple[ir.Populate, ...], depth: int = 1) -> DataFrame:
        """page with a column for each relation named. Related rows aren't filtered by status or locale."""
        if depth > DEPTH:
            return page
        sides = self.catalog.sides(module.name)
        for name, children in resolved(self.catalog, module, nodes, depth).items():
            if name in sides:
                page = self._relation(page, sides[name], name, children, depth)
            elif module.column(name).type == "media":
                page = self._media(page, module.id_field.name, name, module.column(name).kind == "json")
        return page

    def _target(self, side: Side, wanted: DataFrame, children: tuple[ir.Populate, ...], depth: int) -> DataFrame:
        """_there and row, of target rows that wanted (_there) names: only those are expanded further."""
        target = self.catalog.module(side.target)
        rows = self.catalog.rows[side.target]
        rows = rows.join(wanted, rows[target.id_field.name] == wanted["_there"], "left_semi")
        shown = [f.name for f in target.public()]
        plan = resolved(self.catalog, target, children, depth + 1) if depth < DEPTH else {}
        rows = self.expand(rows, target, children, depth + 1) if plan else rows
        return rows.select(column(target.id_field.name).alias("_there"), F.struct(*map(column, [*shown, *plan])).alias("row"))

    def edges(self, page: DataFrame, side: Side) -> DataFrame:
        """_here, _there and edge (its order) of the rows of page."""
        own, other = self.catalog.module(side.owner).id_field.name, self.catalog.module(side.target).id_field.name
        here = page.select(column(own).alias("_here"))
        if side.relation.column and side.here == "owner_id":
            return page.select(column(own).alias("_here"), column(side.relation.column).alias("_there"), F.lit(0).cast("long").alias("edge")).filter("_there IS NOT NULL")
        if side.relation.column:
            target = self.catalog.rows[side.target]
            edges = target.select(column(side.relation.column).alias("_here"), column(other).alias("_there"), column(other).cast("long").alias("edge"))
        else:
            link = self.catalog.links[side.link]
            edges = link.select(F.col(side.here).alias("_here"), F.col(side.there).alias("_there"), F.col("id").cast("long").alias("edge"))
        return edges.join(here.distinct(), "_here", "left_semi")

    def _relation(self, page: DataFrame, side: Side, name: str, children: tuple[ir.Populate, ...], depth: int) -> DataFrame:
        own = self.catalog.module(side.owner).id_field.name
        edges = self.edges(page, side)
        rows = self._target(side, edges.select("_there"), children, depth)
        found = edges.join(rows, "_there")
        if side.to_one:  # of several edges the first
            grouped = found.groupBy("_here").agg(F.min_by("row", F.struct("edge", "_there")).alias(name))
        else:
            ordered = F.array_sort(F.collect_list(F.struct("edge", "_there", "row")), lambda a, b: F.when(a["edge"] < b["edge"], -1).when(a["edge"] > b["edge"], 1).when(a["_there"] < b["_there"], -1).when(a["_there"] > b["_there"], 1).otherwise(0))
            grouped = found.groupBy("_here").agg(F.transform(ordered, lambda e: e["row"]).alias(name))
        joined = page.join(grouped, page[own] == grouped["_here"], "left")
        value = column(name) if side.to_one else F.coalesce(column(name), F.array().cast(grouped.schema[name].dataType))
        return joined.select(*map(column, page.columns), value.alias(name))

    def _media(self, page: DataFrame, own: str, name: str, many: bool) -> DataFrame:
        """Assets in place of their ids; ids of no asset are null, or left out of lists."""
        files = self.catalog.files
        if files is None:
            return page
        asset = files.select(F.col("id").alias("_there"), F.struct(*(c for c in MEDIA_FIELDS if c in files.columns)).alias("row"))
        if not many:
            joined = page.join(asset, page[name] == asset["_there"], "left")
            return joined.select(*(F.col("row").alias(name) if c == name else column(c) for c in page.columns))
        ids = page.select(column(own).alias("_here"), F.posexplode(F.from_json(column(name), "array<bigint>")).alias("edge", "_there"))
        found = ids.join(asset, "_there").groupBy("_here").agg(F.array_sort(F.collect_list(F.struct("edge", "row")), lambda a, b: (a["edge"] - b["edge"]).cast("int")).alias("_rows"))
        rows = F.coalesce(F.transform("_rows", lambda e: e["row"]), F.array().cast(f"array<{asset.schema['row'].dataType.simpleString()}>"))
        joined = page.join(found, page[own] == found["_here"], "left")
        return joined.select(*(rows.alias(name) if c == name else column(c) for c in page.columns))
