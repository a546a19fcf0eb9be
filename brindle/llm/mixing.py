"""Mixing sources to target weights.

The words of each source, in a pseudorandom order of its documents, are packed into blocks of fixed length. The
output is a row of shards of slots. For every shard a multinomial draw says how many slots each source gets; a
source's slots, numbered through all shards, are mapped through a pseudorandom permutation of its block numbers,
another for each pass over the source, and blocks are joined by number. What comes out are spans of documents, slot
by slot (mix), the texts of the slots (packed), or documents with the words that the mix takes of them.

The draw leaves little to chance: a source's whole part of its expected slots in a shard is given outright and the
multinomial draws the slots that remain (residual sampling), which keeps every expectation and cuts the variance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, WORD, forget, written

SHARD, SEED, LIMIT = 1024, 20_240_229, 3
#: Words a block, at least and at most, and the slots that there are before blocks grow.
BLOCKS, SLOTS = (32, 4096), 1 << 20
#: Slots that a task maps through the permutations, and the most tasks.
TASK, TASKS = 50_000, 50_000
#: Rounds of the Feistel permutation of block numbers, and the most steps of its walk.
ROUNDS, STEPS = 4, 40


def words_in(text: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A pseudorandom number from 0 to below 1, of 52 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 12) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = LIMIT) -> DataFrame:
    """sources (source, source_size; a row each) with number and target: all sizes shared by weight, none above limit
    times its size.

    By code point, null last, sources get the weights in turn. Sharing the excess again and again ends at one
    level: a source gets level times weight or its limit, whichever is less. In order of limit over weight those at
    their limit come first, so running sums over that order find the level: it is the first at which a source stays
    below its limit. The windows go over sources, a row each.
    """
    choice = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(choice, (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "number")
    after, so_far = order.rowsBetween(Window.currentRow, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    below = F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("settled", F.first(below, ignorenulls=True).over(so_far))
    return ranked.withColumn("target", F.coalesce(F.least("most", F.col("settled") * F.col("weight")), "most")).select("source", "number", "source_size", "target")


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """index (0 to size - 1) under a keyed permutation of that range: a Feistel network over the least square that
    holds the range, put through again while the number lies outside (cycle walking). Of a square's numbers at most
    two in its root lie outside, so STEPS steps end every walk of ranges below 400, and leave none open in practice
    above (two in twenty, to the power of STEPS)."""
    side = F.ceil(F.sqrt(size.cast("double"))).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / side).cast("long"), F.pmod(x, side)
        for r in range(ROUNDS):
            left, right = right, F.pmod(left + F.pmod(F.xxhash64(right, F.lit(r), *key), side), side)
        return left * side + right

    walk = F.sequence(F.lit(1), F.least((side * side - size), F.lit(STEPS)).cast("int"))
    walked = F.when(side * side == size, once(index)).otherwise(F.aggregate(walk, once(index), lambda x, _: F.when(x < size, x).otherwise(once(x))))
    return F.pmod(walked, size)


def pieces(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (row, id, number, size) with start, the first word's place in its source's stream.

    Documents are dealt into as many buckets as the square root of their number, so that neither the documents of
    a bucket nor the buckets of a source are many, however large a source is; places within a bucket are added to
    the bucket's place.
    """
    n = docs.count()
    buckets = int(n / max(256, n**0.5)) + 1
    dealt = docs.withColumn("order", F.xxhash64(F.lit(seed), "id")).withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 8), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("number", "bucket").orderBy("order", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("number", "bucket").agg(F.sum("size").alias("sum")).select("number", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("first"))
    return within.join(starts, ["number", "bucket"]).select("row", "number", "size", (F.col("first") + F.col("within")).alias("start"))


def block_for(total: int) -> int:
    """Words a block for a mix of total words: a power of two that leaves about SLOTS slots or, from 4 billion words on,
    the most words a block."""
    return min(BLOCKS[1], max(BLOCKS[0], 1 << max(0, (int(total) // SLOTS).bit_length() - 1)))


def _before(rows: DataFrame, keys: str, order: str, per: int, value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows before, by order (whole numbers from 0) among those of equal keys: within buckets of
    `per` numbers, then over the buckets, so that no window holds more than about the root of all."""
    dealt = rows.withColumn("_bucket", F.floor(F.col(order) / F.lit(per)).cast("long"))
    inside = Window.partitionBy(keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(keys, "_bucket").agg(F.sum(value).alias("_sum"))
    sums = sums.select(keys, "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    within = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(sums, [keys, "_bucket"]).withColumn(name, F.col("_base") + F.col("_inside")).drop("_bucket", "_inside", "_base")


def slots(shares: DataFrame, block: int, shard: int = SHARD, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """shares: number, source_size, target. The output's slots, a row each: shard, place (slots of a shard are in its
    order), number, pass, block.

    A shard's draws agree in any run: they are hashes of the seed, the shard and the throw.
    """
    held = shares.filter("source_size > 0 AND target > 0").select("number", "source_size", "target", F.ceil(F.col("source_size") / F.lit(block)).cast("long").alias("blocks"))
    held = held.withColumn("due", F.col("target") * F.col("blocks") / F.col("source_size"))  # slots expected, by the mean length of its blocks
    total = held.agg(F.sum("due")).first()[0] or 0.0
    n = max(1, round(total)) if total else 0
    shards = -(-n // shard)
    # shards are of one size but for the last: two lines of shares serve all
    sizes = [(0, shard), (1, n - max(0, shards - 1) * shard)]
    spark = shares.sparkSession
    lines = held.withColumn("last", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("expected", F.col("due") / F.lit(total or 1.0) * F.when(F.col("last") == 0, F.lit(sizes[0][1])).otherwise(F.lit(sizes[1][1])))
    lines = lines.withColumn("whole", F.floor("expected").cast("long")).withColumn("part", F.col("expected") - F.col("whole"))
    lines = lines.withColumn("high", F.sum("part").over(Window.partitionBy("last").orderBy("number"))).withColumn("low", F.col("high") - F.col("part"))
    lines = written(lines.select("last", "number", "blocks", "whole", "low", "high"), "lines")
    open_of = {r["last"]: (size - r["whole"], r["high"]) for r in lines.groupBy("last").agg(F.sum("whole").alias("whole"), F.max("high").alias("high")).collect() for k, size in sizes if k == r["last"]}
    row = spark.range(shards).select(F.col("id").alias("shard"), (F.col("id") == shards - 1).cast("int").alias("last"))
    given = row.join(lines.filter("whole > 0"), "last").select("shard", "number", "blocks", F.col("whole").alias("count"))  # at most `shard` sources have a whole slot

    def by_last(i: int, kind: str) -> Column:
        value = F.lit(open_of.get(0, (0, 0.0))[i]).cast(kind)
        return F.when(F.col("last") == 0, value).otherwise(F.lit(open_of.get(1, (0, 0.0))[i]).cast(kind))

    throws = row.filter(by_last(0, "int") > 0).withColumn("throw", F.explode(F.sequence(F.lit(1), by_last(0, "int"))))
    throws = throws.withColumn("at", _unit(F.lit(seed), F.col("shard"), F.col("throw")) * by_last(1, "double")).withColumn("cell", F.floor("at").cast("long"))
    cells = lines.filter("high > low").withColumn("cell", F.explode(F.sequence(F.floor("low").cast("long"), F.floor("high").cast("long"))))
    drawn = throws.join(cells, ["last", "cell"]).filter("at >= low AND at < high").select("shard", "number", "blocks", F.lit(1).cast("long").alias("count"))
    counts = given.unionByName(drawn).groupBy("number", "shard").agg(F.sum("count").alias("count"), F.first("blocks").alias("blocks"))
    per = max(1, int(shards**0.5))
    numbered = _before(counts, "number", "shard", per, "count", "first")
    # slots are few bytes each but take a walk each: they are dealt out by their number, not by their size
    spread = numbered.repartition(min(TASKS, max(1, -(-n // TASK))), "number", "shard")
    taken = spread.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    taken = taken.filter(F.col("slot") < F.col("blocks") * F.lit(limit))  # so that no document is taken more than limit times
    taken = taken.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("int")).withColumn("index", F.pmod("slot", "blocks"))
    place = F.xxhash64(F.lit(seed), "number", "slot").alias("place")
    return taken.select("shard", place, "number", "pass", permuted(F.col("index"), F.col("blocks"), F.lit(seed), F.col("number"), F.col("pass")).alias("block"))


class Mix:
    """The mix of docs, as tables: sources (source, number, source_size, target), documents (row, id, number, size) and
    spans(), a row per slot and document in it."""

    def __init__(self, docs: DataFrame, row: Column, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], block: int | None, shard: int, seed: int, limit: int):
        sized = written(docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")), "sizes")
        self.sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit), "targets")
        of_source = self.sources.select(F.col("source").alias("_source"), "number")
        self.documents = written(sized.join(of_source, F.col("source").eqNullSafe(F.col("_source"))).select("row", "id", "number", "size"), "documents")
        forget(sized)
        self.block = block or block_for(self.sources.agg(F.sum("source_size")).first()[0] or 0)
        self.shard, self.seed, self.limit = shard, seed, limit

    def pieces(self) -> DataFrame:
        """row, number, block, offset (of the piece in its block), skip (words of the document before it), words: what
        blocks consist of."""
        block = F.lit(self.block)
        first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
        cut = pieces(self.documents, self.seed).filter("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        at = F.greatest("start", F.col("block") * block)
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - at
        return cut.select("row", "number", "block", (at - F.col("block") * block).alias("offset"), (at - F.col("start")).alias("skip"), words.alias("words"))

    def spans(self) -> DataFrame:
        """shard, place, number, pass, block, offset, row, skip, words: the mix, slot by slot. Blocks are joined by number."""
        return slots(self.sources, self.block, self.shard, self.seed, self.limit).join(self.pieces(), ["number", "block"])


def _mix(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int | None = None, shard: int = SHARD, seed: int = SEED, limit: int = LIMIT) -> Mix:
    return Mix(docs, row, id_col, text_col, source_col, weights, block, shard, seed, limit)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a column _brindle_row, as a written table, so that rows keep their numbers."""
    return written(docs.withColumn("_brindle_row", F.monotonically_increasing_id()), "rows")


def _words(text: Column) -> Column:
    """The words of a text, without the empty ones at its ends."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def packed(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix's blocks: shard, place, number (of the source), block, pass and text, the words of the slot with a space
    between, a row per slot. Options as for mixture()."""
    rows = _numbered(docs)
    mix = _mix(rows, F.col("_brindle_row"), text_col=text_col, **options)
    of_row = rows.select(F.col("_brindle_row").alias("row"), _words(F.col(text_col)).alias("all"))
    cut = mix.pieces().join(of_row, "row").select("number", "block", "offset", F.array_join(F.slice("all", (F.col("skip") + 1).cast("int"), F.col("words").cast("int")), " ").alias("part"))
    blocks = cut.groupBy("number", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda p: p["part"]), " ").alias("text"))
    return slots(mix.sources, mix.block, mix.shard, mix.seed, mix.limit).join(blocks, ["number", "block"]).select("shard", "place", "number", "block", "pass", "text")


def mixture(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken (words the mix takes, repeats counted).

    Options: text_col, source_col, weights (of sources by code point, in turn), block (words a block; by the number
    of words if not given), shard (slots a shard), seed, limit (of passes over a source). Null and empty texts have
    no words: they are in no block and taken is 0. Null is a source of its own, the last. Rows that repeat an id are
    separate documents. A source smaller than a block is one block. Other columns of docs are not read. An empty
    table gives an empty result. The table of sources is broadcast only as far as Spark finds it small.
    """
    mix = _mix(docs, F.monotonically_increasing_id(), id_col=id_col, **options)
    taken = mix.spans().groupBy("row").agg(F.sum("words").alias("taken"))
    sums = mix.sources.select("number", "source_size", "target")
    return mix.documents.join(taken, "row", "left").join(sums, "number").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with what the mix takes of them: a row for each pass that takes words of a document, with the words it takes.

    Of a document taken whole the text stays as it is. Of one taken in part the spans taken stand in their order, with a space
    between words that follow each other in the document and a line feed between others. All other columns stay. Options as for
    mixture().
    """
    rows = _numbered(docs)
    mix = _mix(rows, F.col("_brindle_row"), id_col=id_col, text_col=text_col, **options)
    span = F.struct(F.col("skip").cast("int").alias("skip"), F.col("words").cast("int").alias("words"))
    taken = mix.spans().groupBy("row", "pass").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(span)).alias("spans"))
    wanted = taken.join(mix.documents.select("row", "size"), "row").select(F.col("row").alias("_brindle_row"), F.when(F.col("words") < F.col("size"), F.col("spans")).alias("_brindle_spans"))
    joined = rows.join(wanted, "_brindle_row")

    def cut(words: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            last = F.get("_brindle_spans", i - 1)
            between = F.when(i == 0, "").when(last["skip"] + last["words"] == s["skip"], " ").otherwise("\n")
            return F.concat(between, F.array_join(F.slice(words, s["skip"] + 1, s["words"]), " "))

        return F.array_join(F.transform("_brindle_spans", one), "")

    part = F.transform(F.array(_words(F.col(text_col))), cut)[0]
    text = F.when(F.col("_brindle_spans").isNull(), F.col(text_col)).otherwise(part).alias(text_col)
    return joined.select(*(text if c == text_col else F.col(f"`{c}`") for c in docs.columns))
