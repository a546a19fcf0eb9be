"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 3 bits share at least 5 of their 8 bytes. Posting lists are kept by
sets of byte positions, so that any 5 shared bytes meet in one of them; for the pairs that meet, the shared
positional bytes are counted, pairs below the guaranteed 5 go, and the rest are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import written
from brindle.llm.components import linked

#: Shingles that are hashed and tallied at a time.
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of the shingles of width words, A-Z lower-cased, repeats included."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    n, ones = 0, np.zeros(64, np.int64)
    while hashes := [xxhash.xxh64_intdigest(s, seed) for s in islice(shingles, CHUNK)]:
        n += len(hashes)
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id, fp (signed 64 bits) of each row. Null text is empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (hexadecimal), component_id, links.

    Fingerprints link at `most` or fewer differing bits; component_id is the smallest id reachable. links counts the
    rows with the same fingerprint, itself left out. Null ids stand in a component like any other and don't name
    it, unless it has no other. Empty, null and repeated texts link like any other. Other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")), "distinct")
    joined = linked(distinct.select(F.col("fp").alias("node"), "fp"), lambda pairs: pairs, [], most=most)
    roots = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(least, "root").select("fp", "component_id", (F.col("size") - 1).alias("links"))
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), as_hex(F.col("fp")).alias("fingerprint"), "component_id", "links")
