import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm.mixing import _mix, block_for, mixed_documents, mixture, packed, permuted, targets

from .conftest import by_row


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, held, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in held]
        for s in free:
            target[s] = left * weight[s] / sum(weight[f] for f in free)
        over = [s for s in free if target[s] > limit * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = limit * sizes[s]
            held.add(s)
        left = sum(sizes.values()) - sum(target[s] for s in held)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_sizes_targets_and_limits(frame, corpus, request):
    rows = mixture(request.getfixturevalue(frame)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r[0], size(r[1])) for r in corpus)
    sizes = defaultdict(int)
    for r in corpus:
        sizes[r[3]] += size(r[1])
    assert Counter(r["source_size"] for r in rows) == Counter(sizes[r[3]] for r in corpus)
    target = brute_targets(sizes)
    assert sorted(r["target"] for r in rows) == pytest.approx(sorted(target[r[3]] for r in corpus))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_taken_comes_near_its_target_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 97)), f"s{i % 7}" if i % 3 else "a") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = mixture(docs), mixture(docs.repartition(7))
    assert by_row(first) == by_row(again)
    by_source = first.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(r["taken"] == pytest.approx(r["target"], rel=0.05) for r in by_source)
    assert first.filter("taken % size <> 0").count() > 0  # blocks cut documents


def test_targets_are_held_at_the_limit(spark):
    sizes = {"a": 10, "b": 1, "c": 0, "d": 5000, "e": 7, None: 300}
    found = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 257, 401, 5000])
def test_permutation(spark, n):
    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1)).alias("x"))
    assert sorted(r["x"] for r in df.collect()) == list(range(n))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_taken_by_brute_force_from_the_mix_itself(spark, corpus, docs):
    """Slots are shards full of blocks, blocks are fixed runs of a source's words, no pass takes a block twice, and taken
    counts the words of the slots."""
    mix = _mix(docs.withColumn("row", F.monotonically_increasing_id()), F.col("row"))
    texts = {r["row"]: words_of(r["text"]) for r in docs.withColumn("row", F.monotonically_increasing_id()).collect()}
    spans, streams = mix.spans().collect(), defaultdict(dict)
    for r in mix.pieces().collect():
        streams[r["number"]][r["block"] * mix.block + r["offset"]] = texts[r["row"]][r["skip"] : r["skip"] + r["words"]]
    numbers = {r["row"]: r["number"] for r in mix.documents.collect()}
    for number, pieces in streams.items():  # pieces cover a source's words, each word once
        at = 0
        for start in sorted(pieces):
            assert start == at
            at += len(pieces[start])
        assert Counter(w for p in pieces.values() for w in p) == Counter(w for r, t in texts.items() if numbers[r] == number for w in t)
    slots = defaultdict(list)
    for r in spans:
        slots[r["shard"], r["place"], r["number"], r["pass"], r["block"]].append(r)
    assert len({(s, p) for s, p, *_ in slots}) == len(slots) == len({key[2:] for key in slots}) and max(key[3] for key in slots) <= 2
    shards = Counter(key[0] for key in slots)
    assert set(shards) == set(range(len(shards))) and max(shards.values()) <= 1024
    taken = Counter()
    for (_, _, number, _, block), parts in slots.items():
        own = [w for r in sorted(parts, key=lambda r: r["offset"]) for w in texts[r["row"]][r["skip"] : r["skip"] + r["words"]]]
        run = [w for start in sorted(streams[number]) for w in streams[number][start]][block * mix.block : (block + 1) * mix.block]
        assert own == run
        for r in parts:
            taken[r["row"]] += r["words"]
    got = Counter((r["doc_id"], r["taken"]) for r in mixture(docs).collect())
    assert got == Counter((r["doc_id"], taken[r["row"]]) for r in docs.withColumn("row", F.monotonically_increasing_id()).collect())
    blocks = packed(docs).collect()
    assert sum(len(r["text"].split(" ")) for r in blocks) == sum(taken.values()) and len(blocks) == len(slots)
    assert Counter(w for r in blocks for w in r["text"].split(" ")) == Counter(w for r in spans for w in texts[r["row"]][r["skip"] : r["skip"] + r["words"]])


def test_block_grows_with_the_data_by_a_rule():
    assert [block_for(n) for n in (0, 10**5, 10**8, 10**9, 6 * 10**9, 10**13)] == [32, 32, 64, 512, 4096, 4096]


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_mixed_documents(frame, corpus, request):
    docs = request.getfixturevalue(frame)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken, rows = Counter(), out.collect()
    for r in rows:
        taken[r["doc_id"]] += len(words_of(r["text"]))
    expected = Counter()
    for r in mixture(docs).collect():
        expected[r["doc_id"]] += r["taken"]
    assert +taken == +expected
    by_id = {r[0]: r for r in corpus}
    once = [r for r in rows if Counter(c[0] for c in corpus)[r["doc_id"]] == 1]
    assert max(Counter(r["doc_id"] for r in once).values()) <= 3 and any(r["text"] == by_id[r["doc_id"]][1] for r in once)
    for r in once:
        rest = iter(words_of(by_id[r["doc_id"]][1]))
        assert all(w in rest for w in words_of(r["text"]))  # in order


def test_empty(empty):
    assert mixture(empty).collect() == [] and mixed_documents(empty).collect() == []
