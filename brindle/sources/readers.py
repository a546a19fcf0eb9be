"""Rows from outside: JDBC tables, files of assets, and generated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.columns import ms_instant
from brindle.operators.filters import column
from brindle.sources.catalog import Module


def jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table over JDBC, 5000 rows a fetch; with bounds of its key read in parts side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=5000, **options)
    if bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def coerced(rows: DataFrame, module: Module) -> DataFrame:
    """A module's columns, in order, with its types: instants cut to milliseconds, json as text, 64-bit numbers exact."""
    out = []
    for f in module.columns():
        c = column(f.name)
        out.append((ms_instant(c).cast(f.spark) if f.kind == "date" else c.cast(f.spark)).alias(f.name))
    return rows.select(*out)


def links(rows: DataFrame, owners: DataFrame, owner_key: str, targets: DataFrame, target_key: str) -> tuple[DataFrame, DataFrame]:
    """(edges with both ends, edges without one): the second are left out and worth a warning."""
    ends = rows.join(owners.select(column(owner_key).alias("owner_id"), F.lit(True).alias("_o")), "owner_id", "left").join(targets.select(column(target_key).alias("related_id"), F.lit(True).alias("_t")), "related_id", "left")
    there = F.col("_o").isNotNull() & F.col("_t").isNotNull()
    shape = ["id", "owner_id", "related_id"]
    return ends.filter(there).select(*shape), ends.filter(~there).select(*shape)


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """Files as assets, addressed by content: one row for each different content, numbered in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    first = named.groupBy("hash").agg(F.min(F.struct("path", "name", "size")).alias("of"))
    ext = F.lower(F.regexp_extract("of.name", r"(\.[^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    mime = F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream"))
    return first.select(F.xxhash64("hash").alias("id"), F.col("of.name").alias("name"), "hash", ext.alias("ext"), mime.alias("mime"), F.col("of.size").alias("size"), F.col("of.path").alias("url"))


#: MIME types of common endings: fixed values.
MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".mp4": "video/mp4", ".webm": "video/webm", ".mp3": "audio/mpeg", ".wav": "audio/wav", ".pdf": "application/pdf", ".txt": "text/plain"}


def asset_page(files: DataFrame, start: int = 0, limit: int = 25) -> DataFrame:
    return files.orderBy(F.desc("id")).offset(start).limit(limit)


def assets_by_hash(files: DataFrame, hashes: DataFrame) -> DataFrame:
    return files.join(hashes.select("hash"), "hash", "left_semi")


def generated(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Deterministic articles: every eleventh value missing, the same for a seed whatever the partitions."""
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 31))
    missing = lambda k, c: F.when(h(k + 100) % 11 != 0, c)
    at = lambda k: F.timestamp_millis(F.lit(1_600_000_000_000) + h(k) * 50).cast("timestamp_ntz")
    status = F.element_at(F.array(F.lit("draft"), F.lit("published"), F.lit("archived")), (h(1) % 3 + 1).cast("int"))
    return spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("id"), at(9).alias("created_at"), at(8).alias("updated_at"),
        missing(2, F.concat(F.lit("Title "), h(2).cast("string"))).alias("title"), F.concat(F.lit("body "), h(3).cast("string")).alias("body"), status.alias("status"),
        missing(4, (h(4) % 1_000_000).cast("int")).alias("views"), missing(5, (h(5) % 500) / 100).alias("rating"), (h(6) % 2 == 0).alias("active"),
    )
