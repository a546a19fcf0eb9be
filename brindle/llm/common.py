"""What the training-data operators share: the shared folder, written tables, byte-level text rules."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space by bytes (space, tab to carriage return) and what lies between: fixed patterns of the contracts.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Only where that is unset and the master is local (tests, one machine)
    a temporary one is set; executors elsewhere couldn't read it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = held.get()
    return f"{conf.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: the lineage ends there and any executor may be lost.

    release, after a large shuffle, collects garbage on the driver, so that Spark drops shuffle files that nothing
    refers to any more instead of keeping them until it happens to.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no plan will read any more; others are let be."""
    for table in tables:
        if not hasattr(table, "path"):
            continue
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def salted(key_side: DataFrame, salts: int) -> DataFrame:
    """Each row once per salt, in column _salt: the small side of a join whose other side has hot keys."""
    return key_side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(column: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


#: Most bits of the bitmap of sifted(): a broadcast of at most 2^20 rows of two numbers, whatever the data's size.
SIFT_BITS = 26


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame | None:
    """rows with _hit, which is true where the key (a number) is in the column of that name of wanted, a written table, and
    for some others; nothing where wanted has more keys than a bitmap of bounded size tells apart."""
    n = wanted.count()
    if n > 1 << SIFT_BITS:
        return None
    bits = 1 << min(SIFT_BITS, max(16, (64 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.lit(11), c), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_place", F.lit(64)).cast("int"))
    bitmap = wanted.select(place(F.col(key)).alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    met = rows.withColumn("_place", place(F.col(key))).join(F.broadcast(bitmap), F.shiftright("_place", 6) == F.col("_word"), "left")
    return met.select(*rows.columns, F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False)).alias("_hit"))


def sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key (a number) is in the column of that name of wanted, a written table, and some others.

    Keys are hashed into a bitmap of bounded size, 64 bits a row, which is broadcast, so that most rows that the join
    to come would lose aren't shuffled for it. (That join has to be an inner one: a semi-join Spark would do first.) With
    more keys than bits it would let nearly all through, so that the rows are left to the join as they are.
    """
    marked = _marked(rows, key, wanted)
    return rows if marked is None else marked.filter("_hit").drop("_hit")


def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows left joined with a written table of different keys, but for shuffling those that aren't in it."""
    marked = _marked(rows, key, table)
    if marked is None:
        return rows.join(table, key, "left")
    others = [F.lit(None).cast(t).alias(c) for c, t in table.dtypes if c != key]
    missed = marked.filter("NOT _hit").select(*rows.columns, *others)
    return marked.filter("_hit").drop("_hit").join(table, key, "left").select(*missed.columns).unionByName(missed)


#: White space beside white space: where it occurs, a text isn't cut into words.
APART = re.compile(r"\s\s")


def by_words(texts: list[str], ids_of: Callable[[list[str]], list[bytes]], uncut: re.Pattern) -> list[bytes]:
    """The packed ids of each text; ids_of gets distinct pieces of texts and returns theirs.

    GPT-2's pattern never joins what stands before a single space or line feed with what follows it, if neither
    neighbour is white space. So a text is cut into words, each with the space before it, and the ids of its words,
    one after the other, are the text's. Texts in which white space meets white space, or in which uncut is found, are one piece. Cutting,
    telling words apart and putting ids together are Arrow's, a word each.
    """
    whole = [i for i, t in enumerate(texts) if "\0" in t or APART.search(t) or uncut.search(t)]
    skip = set(whole)
    cut = pa.array([t for i, t in enumerate(texts) if i not in skip], pa.large_string())
    cut = pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0")
    words = pc.split_pattern(cut, "\0")
    # (an offset into the list array, which may be a slice, is taken off)
    places = words.offsets.to_numpy()
    flat = words.values.slice(places[0], places[-1] - places[0]).dictionary_encode() if len(words) else pa.array([], pa.large_string()).dictionary_encode()
    ids = pa.array(ids_of(flat.dictionary.to_pylist()), pa.large_binary()).take(flat.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] else memoryview(b"")
    found = iter([bytes(data[ends[a] : ends[b]]) for a, b in pairwise((places - places[0]).tolist())])
    by_whole = dict(zip(whole, ids_of([texts[i] for i in whole]), strict=True))
    return [by_whole[i] if i in skip else next(found) for i in range(len(texts))]
