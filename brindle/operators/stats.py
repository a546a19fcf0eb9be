"""Counts and summaries: dashboards, inspection, and what a migration asks before it changes a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.filters import column
from brindle.sources.catalog import Catalog, Module


def counts(catalog: Catalog) -> DataFrame:
    """module and rows of each."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("module"), "rows") for name, df in sorted(catalog.rows.items())]
    return reduce(DataFrame.unionByName, parts)


def recent(catalog: Catalog, n: int = 3) -> DataFrame:
    """module, id and updated_at of the rows changed last, over all modules that keep that time: the newest n of each
    module first, so that the union is small."""
    parts = []
    for name, df in sorted(catalog.rows.items()):
        own = catalog.module(name).id_field.name
        if "updated_at" in df.columns:
            parts.append(df.select(F.lit(name).alias("module"), column(own).cast("long").alias("id"), "updated_at").orderBy(F.desc("updated_at"), "id").limit(n))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("updated_at"), "module", "id").limit(n)


def inspect(rows: DataFrame, module: Module, sample: int = 5) -> DataFrame:
    """A row per column: type, nulls, distinct (approximately) and least values as a sample; one pass over the rows."""
    fields = module.columns()
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = column(f.name)
        aggregates += [F.count_if(c.isNull()).alias(f"nulls{i}"), F.approx_count_distinct(c).alias(f"distinct{i}"), F.min(c).cast("string").alias(f"min{i}"), F.max(c).cast("string").alias(f"max{i}")]
    one = rows.agg(*aggregates)
    entries = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.kind).alias("type"), F.col("rows"), F.col(f"nulls{i}").alias("nulls"), F.col(f"distinct{i}").alias("distinct"), F.col(f"min{i}").alias("least"), F.col(f"max{i}").alias("greatest")) for i, f in enumerate(fields)))
    return one.select(F.inline(entries))


def window(rows: DataFrame, module: Module, start: int = 0, limit: int = 50) -> DataFrame:
    """Some rows in order of id, at most 200: a feature of inspection."""
    return rows.orderBy(column(module.id_field.name)).offset(start).limit(min(limit, 200))


def too_long(rows: DataFrame, name: str, length: int) -> DataFrame:
    return rows.filter(F.char_length(column(name)) > length).agg(F.count(F.lit(1)).alias("n"))


def loses_scale(rows: DataFrame, name: str, scale: int) -> DataFrame:
    c = column(name)
    return rows.filter(c != F.round(c, scale)).agg(F.count(F.lit(1)).alias("n"))


def nulls(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(column(name).isNull()).agg(F.count(F.lit(1)).alias("n"))
