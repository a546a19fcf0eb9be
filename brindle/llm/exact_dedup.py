"""Exact dedup by progressive refinement: length, then a hash of the prefix, then the hash of the whole text.

Each level only sees rows that another row equals at the level before, so whole texts are hashed for few rows,
unless digests of all rows are asked for. Only keys, never texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, salt_of, salted, written

SALTS = 16


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _colliding(rows: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """The rows that share their keys with another row. Rows are dealt by salted keys: a hot key stays spread."""
    shared = rows.groupBy(*keys).count().filter("count > 1").drop("count")
    return rows.withColumn("_salt", salt_of(F.struct(*rows.columns), salts)).join(salted(shared, salts), [*keys, "_salt"], "left_semi").drop("_salt")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, all_digests: bool = False, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after white space runs become one space; null is the empty text, and empty
    texts are equal. The smallest id of equal texts stays; null ids come after all others. Of rows that repeat
    id and text exactly one is kept. text_sha256 is null where no other row came as far, unless all_digests.
    Other columns of docs, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    sized = written(rows.select("id", F.length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, prefix)).alias("p")), "sizes")
    near = _colliding(_colliding(sized, ["n"], salts), ["n", "p"], salts)
    seen = near.select(F.col("id").alias("near_id")).distinct().withColumn("near", F.lit(True))
    if not all_digests:  # whole texts are read where a prefix was met twice
        whole = rows.join(seen, F.col("id").eqNullSafe(F.col("near_id")), "left")
        hashed = whole.select("id", F.coalesce("near", F.lit(False)).alias("near"), F.when(F.col("near"), F.sha2("norm", 256)).alias("sha"))
    else:
        hashed = rows.select("id", F.sha2("norm", 256).alias("sha")).join(seen, F.col("id").eqNullSafe(F.col("near_id")), "left").select("id", F.coalesce("near", F.lit(False)).alias("near"), "sha")
    counted = written(hashed.groupBy("id", "near", "sha").agg(F.count(F.lit(1)).alias("copies")), "hashes")
    groups = counted.filter("near").groupBy("sha").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")).filter("group_size > 1")
    joined = counted.withColumn("_salt", salt_of(F.col("id"), salts)).join(salted(groups, salts), ["sha", "_salt"], "left")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("id"))
    return each.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.when(grouped, F.col("group_size")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(keep) & ((F.col("copy") == 1) | ~grouped)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
