import random
import zlib

import numpy as np
import pytest
from brindle.llm import quality, toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic, poor = rng.random() < 0.2, rng.random() < 0.25
        if rng.random() < 0.5:  # toxic documents name groups more often, which alone means nothing
            text[3] = rng.choice(("women", "muslims", "immigrants")) if toxic or rng.random() < 0.15 else "people"
        if toxic:
            text[rng.randrange(5, 15)] = rng.choice(("vileness", "vilely", "wretchedest", "wretches"))
        joined = " ".join(w.upper() + "!!" if poor else w for w in text) + "."
        rows.append((i, joined))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
    return sum(a == b for a, b in rows) / len(rows)


def test_held_out_accuracy_and_folds(labelled):
    docs, labels = labelled
    for module, label, parts, held in ((quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)):
        model = module.fit(docs, labels)
        scored = module.score(docs, model)
        assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
        rows = scored.collect()
        assert len(rows) == 1500 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert accuracy(scored, labels, label) > 0.95
        # labels of the held-out part are never read, and neither are other columns
        flipped = labels.withColumn(label, F.when(quality.part_of(F.col("doc_id"), parts) == held, 1 - F.col(label)).otherwise(F.col(label)))
        other = docs.withColumns({c: F.lit(1) for c in ("lang", "source", "score", "y", "id")}).repartition(7)
        again = {r["doc_id"]: r["score"] for r in module.score(other, module.fit(other, flipped)).collect()}
        assert again == pytest.approx({r["doc_id"]: r["score"] for r in rows})


def test_swaps_change_scores_less_with_the_penalty(labelled):
    docs, labels = labelled
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    y = np.array([float(r["toxic"]) for r in labels.orderBy("doc_id").collect()])
    texts = [rows[i] for i in range(1500)]
    names = sorted({t for x in texts for t in toxicity.tokens(x)} | set(toxicity.SWAP))
    at = {t: i for i, t in enumerate(names)}
    index = lambda tokens: sorted(at[t] for t in tokens if t in at)
    pairs = [(index(a), index(b)) for x in texts for a, b in toxicity.counterfactuals(x)]
    assert len(pairs) > 100

    def change(weight):
        model = toxicity.train([index(toxicity.tokens(x)) for x in texts], y, pairs, names, weight)
        neutral = ["all women came here", "muslims live there", "immigrants work in town"]
        return sum(abs(model.logit(s) - model.logit(s.replace("women", "men").replace("muslims", "christians").replace("immigrants", "refugees"))) for s in neutral), model

    (plain, _), (fair, model) = change(0.0), change(5.0)
    assert fair < plain / 3
    assert model.score("the vileness of it") > 0.5 > model.score("women came")


def test_swaps():
    ((before, after),) = toxicity.counterfactuals("Nothing here. The Women sang! again")
    assert "women" in before and "men" in after and "sang" in before & after
    assert toxicity.counterfactuals("") == [] and toxicity.tokens("") == set()
    assert all(toxicity.SWAP[t] != t for t in toxicity.SWAP)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, pairs=1)
    assert [p[:2] for p in model.pairs] == [(0, 1)]
    z = rng.random((1000, 3))
    assert (((z[:, 0] > 0.5) ^ (z[:, 1] > 0.5)) == (model.scores(z) > 0.5)).mean() > 0.93
    total = model.intercept + sum(t[np.searchsorted(e, z[:, f], "right")] for f, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    (f, g, a, b, t), = model.pairs
    assert np.allclose(total + t[np.searchsorted(a, z[:, f], "right"), np.searchsorted(b, z[:, g], "right")], model.logits(z))


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_odd_rows(frame, corpus, labelled, request, spark):
    df = request.getfixturevalue(frame)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(120)] + [(None, 1, 1), (3, None, None), (5, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
        rows = module.score(df, module.fit(df, labels)).collect()
        assert len(rows) == len(corpus) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
        assert label in labels.columns
        one = labels.filter(f"{label} = 1")
        assert [r["score"] for r in module.score(df, module.fit(df, one)).collect()] == pytest.approx([1] * len(corpus), abs=1e-9)


def test_empty(empty, docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert module.score(empty, module.fit(empty, labels)).collect() == []
        assert module.score(docs, module.fit(docs, labels)).count() == docs.count()
    assert quality.kept(empty, quality.fit(docs, labels)).collect() == [] and quality.kept(docs, quality.fit(docs, labels)).count() == docs.count()
