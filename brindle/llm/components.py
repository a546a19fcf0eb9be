"""Connected components as rounds of joins, and links between rows that share posting lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import forget, looked_up, salt_of, salted, sifted, written

#: Ways that the rows of a hot node are split in joins.
SALTS = 8
#: Pairs a member, of different components, from which a posting list is split instead of being paired.
HOT = 16


def _looked_up(rows: DataFrame, by: str, table: DataFrame, value: str) -> DataFrame:
    """rows with the value that table (node, value) has for the node in column by, or null. Rows that share a node are
    split by salts; of the table only what rows name takes part, each of it once per salt."""
    named = rows.select(F.col(by).alias("node")).distinct()
    wanted = salted(table.join(named, "node", "left_semi").select(F.col("node").alias(by), value), SALTS)
    split = rows.withColumn("_salt", salt_of(F.struct(*rows.columns), SALTS))
    return split.join(wanted, [by, "_salt"], "left").select(*(split[c] for c in rows.columns), F.col(value))


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for each node that an edge (a, b) touches and that isn't its own root.

    Every round hooks each node to its smallest neighbour, shortens the hooks to their ends by pointer jumping and
    carries the edges over to those ends; edges within an end go. Chains take as many jumps as the logarithm of
    their length, and stars one round. All tables are in the shared folder, and go when they have been read for the
    last time; nothing but counts comes to the driver.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    left = written(edges.filter("a <> b").select(low, high).distinct(), "edges")
    roots = None
    while not left.isEmpty():
        hooks = written(left.groupBy("high").agg(F.min("low").alias("root")).withColumnRenamed("high", "node"), "hooks")
        while True:
            up = hooks.select("node", F.col("root").alias("above"))
            moved = _looked_up(hooks, "root", up, "above").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            jumped = written(moved, "hooks")
            forget(hooks)
            hooks = jumped
            if jumped.filter("moved").isEmpty():
                break
        up = hooks.select("node", F.col("root").alias("above"))
        ends = hooks.select("node", "root")
        if roots is None:
            roots = written(ends, "roots")
        else:
            longer = written(_looked_up(roots, "root", up, "above").select("node", F.coalesce("above", "root").alias("root")).unionByName(ends), "roots")
            forget(roots)
            roots = longer
        carried = left
        for side in ("low", "high"):
            carried = _looked_up(carried, side, up, "above").select(F.coalesce("above", side).alias(side), *(c for c in ("low", "high") if c != side))
        carried = written(carried.filter("low <> high").select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct(), "edges")
        forget(left, hooks)
        left = carried
    if roots is None:
        return left.select(F.col("low").alias("node"), F.col("high").alias("root"))
    forget(left)
    return roots


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Roots by components of nodes (first) whose roots were joined further (second)."""
    up = second.select("node", F.col("root").alias("above"))
    moved = _looked_up(first, "root", up, "above").select("node", F.coalesce("above", "root").alias("root"))
    return moved.unionByName(second.join(first.select("node"), "node", "left_anti"))


def _few(pairs: DataFrame) -> DataFrame:
    """Two pairs (a_node, b_node, a_root < b_root) at random of each a_node: of nodes that are all alike each meets one of a greater
    root, so that all are joined, by as many pairs as there are nodes and not the square of that."""
    ends = [c for c in pairs.columns if c != "a_node"]
    of = F.struct(F.xxhash64("a_node", "b_node").alias("h"), *ends)
    each = pairs.groupBy("a_node").agg(F.min(of).alias("x"), F.max(of).alias("y")).select("a_node", F.explode(F.array_distinct(F.array("x", "y"))).alias("p"))
    return each.select(*(F.col(c) if c == "a_node" else F.col(f"p.{c}").alias(c) for c in pairs.columns))


def link(lists: DataFrame, columns: list[str], near: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame, DataFrame], DataFrame] | None, depth: int, close: Column | None = None, met: Column | int = 1, hot: int = HOT, first_by: tuple[str, ...] = (), crowded: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]] | None = None) -> DataFrame:
    """node, root of all nodes joined, directly or by others, by links that near() confirms.

    lists: a written table, which goes, of posting lists: key, columns (node among them) and what split() needs, a row
    per node and list. near(pairs) gets pairs of nodes (a_ and b_ before the columns) for which close holds and that
    met in as many lists as met says, and returns those that are links.

    A list of m nodes isn't expanded into its pairs. First each of its nodes meets the first alone, in order of
    first_by and node. Then only nodes that are in different components so far meet, which finds every link that
    could still join two components; a large group of near copies has become one component by then. Lists that even so
    hold more than `hot` such pairs a member are split, depth times at most: split(rows, lists) posts their rows under keys that
    hold more of what two links share. Where lists are still hot after that all pairs of theirs meet: without crowded() like
    those of any list; crowded(rows) gets the rows of all lists that are left (key, columns, root, hot and the list's size m), and returns
    a_root, b_root, a_node, b_node of some pairs that share a hot list, as many as there are rows, and a function. A few of these and of
    the pairs of other lists, two a node, are looked at first. The function gets node, root of what they joined, and returns all the pairs that
    close and met allow, share a hot list and are in different components even so; these are looked at with all pairs of other lists of which the same holds.
    """
    close = F.lit(True) if close is None else close
    a, b = ([F.col(c).alias(f"{s}_{c}") for c in columns] for s in "ab")
    order = (*first_by, "node")

    def enough(pairs: DataFrame) -> DataFrame:
        rest = [c for c in pairs.columns if c not in ("a_node", "b_node")]
        tallied = pairs.groupBy("a_node", "b_node").agg(F.count(F.lit(1)).alias("met"), *(F.first(c).alias(c) for c in rest))
        return tallied.filter(F.col("met") >= met).drop("met")

    # each node of a list beside its first
    rank = F.struct(*order, *(c for c in columns if c not in order))
    hubs = lists.groupBy("key").agg(F.min(rank).alias("hub")).select("key", *(F.col(f"hub.{c}").alias(f"b_{c}") for c in columns))
    stars = lists.select("key", *a).join(hubs, "key").filter((F.col("a_node") != F.col("b_node")) & close).drop("key")

    first = components(near(enough(stars)).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    level, found, tables = lists, [], []
    for times in range(depth + 1):
        labelled = written(looked_up(level, "node", first).withColumn("root", F.coalesce("root", "node")), "labelled", release=True)
        parts = labelled.select("key", "root").repartition("key").groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same"))
        mixed = parts.select("key", ((F.col("m") * F.col("m") - F.col("same")) / 2).alias("cross"), "m").filter("cross > 0")
        mixed = mixed.select("key", "m", (F.col("cross") > F.col("m") * hot).alias("hot"))
        rest = written(labelled.join(mixed, "key"), "mixed", release=True)
        forget(labelled)
        tables.append(rest)
        paired = rest if times == depth and crowded is None else rest.filter("NOT hot")
        left = paired.select("key", F.col("root").alias("a_root"), *a)
        right = paired.select("key", F.col("root").alias("b_root"), *b)
        # of two nodes the one in the smaller component is a, in every list they share
        found.append(left.join(right, "key").filter((F.col("a_root") < F.col("b_root")) & close).drop("key"))
        if times == depth or (again := rest.filter("hot").drop("hot", "m", "root")).isEmpty():
            break
        level = written(split(again, lists), f"split{times}", release=True)
        tables.append(level)
    pairs = enough(reduce(DataFrame.unionByName, found))
    ends = F.col("a_root").alias("a"), F.col("b_root").alias("b")
    if crowded is not None:
        some, further = crowded(rest)
        whole = written(pairs.select(*some.columns), "tallied", release=True)
        begun = components(near(_few(whole.unionByName(some))).select(*ends))
        up, apart = begun.select("node", F.col("root").alias("above")), whole
        for side in ("a_root", "b_root"):
            apart = _looked_up(apart, side, up, "above").withColumn(side, F.coalesce("above", side)).drop("above")
        joined = components(near(apart.filter("a_root <> b_root").unionByName(further(begun))).select(*ends))
        second = written(merged(begun, joined), "roots")
        tables.extend((whole, begun, joined))
    else:
        second = components(near(pairs).select(*ends))
    out = written(merged(first, second), "linked", release=True)
    forget(lists, first, second, *tables)
    return out


def shared(lists: DataFrame, release: bool = False) -> DataFrame:
    """Posting lists (key, node and others) of more than one node, each of them once, as a written table."""
    counts = written(lists.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("key"), "counts", release=release)
    out = written(sifted(lists, "key", counts).join(counts, "key").dropDuplicates(["key", "node"]), "lists", release=release)
    forget(counts)
    return out


def covering(positions: int, least: int, width: int) -> list[tuple[int, ...]]:
    """Sets of width positions such that any least positions hold one of them whole.

    Where the positions can be split into groups so that least of them must meet width times in one, all sets within
    the groups do.
    """
    if not 1 <= width <= least:
        raise ValueError("width must be from 1 to least")
    if width == 1:
        return [(i,) for i in range(positions - least + 1)]
    groups = (least - 1) // (width - 1)
    return [c for g in range(groups) for c in combinations(range(g, positions, groups), width)]


def part(fp: Column, at: Column | int, bits: int) -> Column:
    shift = at * bits if isinstance(at, int) else (at * F.lit(bits)).cast("int")
    return F.call_function("shiftrightunsigned", fp, F.lit(shift) if isinstance(shift, int) else shift).bitwiseAND(F.lit((1 << bits) - 1))


def tallied(pairs: DataFrame, positions: int = 8, most: int = 3, bits: int = 8) -> DataFrame:
    """pairs (a_fp, b_fp) that share at least positions - most parts, the fewest that fingerprints of at most `most`
    differing bits can share, with that number as column shared."""
    same = [(part(F.col("a_fp"), i, bits) == part(F.col("b_fp"), i, bits)).cast("int") for i in range(positions)]
    return pairs.withColumn("shared", reduce(lambda x, y: x + y, same)).filter(F.col("shared") >= positions - most)


def linked(nodes: DataFrame, near: Callable[[DataFrame], DataFrame], extra: list[str], positions: int = 8, most: int = 3, bits: int = 8, width: int = 3) -> DataFrame:
    """node, root of all nodes joined, directly or by others, by fingerprints of at most `most` differing bits that
    near() confirms; nodes: node, fp and the columns named in extra, a row per node.

    An inverted index by positional parts: lists are kept for sets of width positions, whatever the number of nodes.
    Pairs that meet in a list are tallied, those that share fewer parts than two near fingerprints must go, and the
    rest are compared bit by bit. A list that gets hot is split by a part more: of the positions left two links share all but `most`, so
    one more than those are posted. The index grows by that factor (4 of 8 bytes) where and only where lists are hot.
    """
    least = positions - most
    columns = ["node", "fp", *extra]
    places = covering(positions, least, width)
    posted = [F.struct(F.xxhash64(F.lit(n), *(part(F.col("fp"), i, bits) for i in at)).alias("key"), F.lit(sum(1 << i for i in at)).alias("used")) for n, at in enumerate(places)]
    lists = shared(nodes.select(*columns, F.inline(F.array(*posted))))

    def split(rows: DataFrame, _: DataFrame) -> DataFrame:
        left = F.slice(F.filter(F.array(*map(F.lit, range(positions))), lambda i: F.getbit(F.col("used"), i) == 0), 1, most + 1)
        further = rows.select(*columns, "used", "key", F.explode(left).alias("at"))
        key = F.xxhash64("key", "at", part(F.col("fp"), F.col("at"), bits))
        return further.select(key.alias("key"), *columns, F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("at"))).alias("used"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        counted = tallied(pairs, positions, most, bits)
        return near(counted.filter(F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= most).drop("shared"))

    return link(lists, columns, confirmed, split, least - width)
