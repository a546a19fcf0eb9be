import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm.components import components, covering, linked, tallied
from brindle.llm.simhash import near_dedup

from .conftest import by_row


def brute_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(items, near):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in combinations(range(len(items)), 2):
        if near(items[i], items[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_covering():
    for positions, least in ((8, 5), (6, 3), (7, 4)):
        for width in range(2, least + 1):
            sets = covering(positions, least, width)
            assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(positions), least))


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_like_brute_force(frame, corpus, request):
    fps = [brute_fingerprint(r[1]) for r in corpus]
    roots = brute_roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, root in zip(corpus, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    expected = sorted(((r[0], f"{fp:016x}", least.get(root), fps.count(fp) - 1) for r, fp, root in zip(corpus, fps, roots, strict=True)), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
    assert by_row(near_dedup(request.getfixturevalue(frame))) == expected


def test_dense_and_chained_fingerprints(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):  # groups of near fingerprints, and chains whose ends are far apart
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        for _ in range(40):
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    roots = brute_roots(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    nodes = spark.createDataFrame([(x,) for x in fps], "node long").withColumn("fp", F.col("node"))
    found = {r["node"]: r["root"] for r in linked(nodes, lambda p: p, []).collect()}
    assert [found.get(x, x) for x in fps] == [fps[r] for r in roots]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    nodes = sorted({x for e in edges for x in e})
    linked_pairs = {frozenset(e) for e in edges}
    roots = brute_roots(nodes, lambda a, b: frozenset((a, b)) in linked_pairs)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [found.get(n, n) for n in nodes] == [nodes[r] for r in roots]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tally_removes_pairs_before_they_are_compared(spark):
    pairs = spark.createDataFrame([(0, 0x0700000000000000), (0, 0x0101010100000000), (0, 0x01010100), (-1, -1)], "a_fp long, b_fp long")
    assert sorted((r["b_fp"], r["shared"]) for r in tallied(pairs).collect()) == [(-1, 8), (0x01010100, 5), (0x0700000000000000, 7)]


@pytest.mark.parametrize("n", [60, 2000])
def test_hot_lists_are_split_and_no_link_is_lost(spark, n):
    """Fingerprints that share three bytes, some of them near."""
    rng = random.Random(n)
    fps = sorted({(rng.getrandbits(40) << 24 | 0xABCDEF) & (1 << 63) - 1 for _ in range(n)} | {x ^ 1 << 30 ^ 1 << 50 for x in ((7 * i) << 32 | 0xABCDEF for i in range(40))} | {(7 * i) << 32 | 0xABCDEF for i in range(40)})
    near = lambda a, b: (a ^ b).bit_count() <= 3
    roots = brute_roots(fps, near)
    nodes = spark.createDataFrame([(x,) for x in fps], "node long").withColumn("fp", F.col("node"))
    found = {r["node"]: r["root"] for r in linked(nodes, lambda p: p, []).collect()}
    assert [found.get(x, x) for x in fps] == [fps[r] for r in roots]


def test_empty(empty):
    assert near_dedup(empty).collect() == []
