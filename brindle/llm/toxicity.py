"""Toxicity by a counterfactually regularised classifier.

A logistic model of which words, and beginnings of words, a text has. In labelled sentences identity terms are
swapped for others of their kind; training penalises the square of the change in score that a swap makes. So the
mention of a group neither raises nor lowers a score, though toxic sentences mention groups more often.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.quality import labelled_sample, part_of

#: The most labelled documents learned from, in expectation, and the most features kept: parameters, not growing with data.
SAMPLE, FEATURES = 20_000, 4000
#: Least evidence (log-likelihood ratio) for a feature to be kept.
EVIDENCE = 6.0
#: Weight of the ridge, of the counterfactual penalty and of a toxic document (which are few); steps of training.
RIDGE, COUNTERFACTUAL, TOXIC, STEPS = 1e-4, 1.0, 2.0, 300
#: Lengths of the beginnings of words that count besides whole words: stems, whatever ending follows.
STEMS = (3, 4, 5, 6)

#: Identity terms by kind, in the four languages: a term is swapped for the next of its kind and language.
IDENTITIES = (
    "women men", "woman man", "girls boys", "she he", "female male", "wife husband", "mothers fathers",
    "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "black white asian latino", "gay lesbian straight bisexual transgender", "immigrants refugees citizens natives", "old young", "disabled deaf blind",
    "femmes hommes", "femme homme", "musulmans chrétiens juifs", "noirs blancs", "immigrés réfugiés",
    "frauen männer", "frau mann", "muslime christen juden", "schwarze weiße", "einwanderer flüchtlinge",
    "mujeres hombres", "mujer hombre", "musulmanes cristianos judíos", "negros blancos", "inmigrantes refugiados",
)
SWAP = {t: kind[(i + 1) % len(kind)] for kind in (k.split() for k in IDENTITIES) for i, t in enumerate(kind)}

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str) -> set[str]:
    """The different words of a text, lower-cased, and their beginnings, marked by a hyphen."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """Tokens of each sentence with identity terms, before and after the swap."""
    pairs = []
    for sentence in _SENTENCE.split(text):
        words = set(_WORD.findall(sentence.lower()))
        if not words.isdisjoint(SWAP):
            swapped = _WORD.sub(lambda m: SWAP.get(m[0].lower(), m[0]), sentence)
            pairs.append((tokens(sentence), tokens(swapped)))
    return pairs


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def logit(self, text: str) -> float:
        w = self.weights
        return self.intercept + sum(map(w.__getitem__, sorted(w.keys() & tokens(text))))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.logit(text)))))


class _Rows:
    """Sparse rows of ones, or of signed ones."""

    def __init__(self, rows: list[list[int]], signs: list[list[float]] | None, width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.value = np.ones(len(self.col)) if signs is None else np.array([s for r in signs for s in r])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.value, self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row] * self.value, self.width)


def train(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], names: list[str], counterfactual: float = COUNTERFACTUAL) -> Model:
    """rows: indices into names of each document; pairs: of a sentence before and after the swap. Of one label alone,
    or of no rows, nothing is learned: every score is that label's, or 0."""
    if not len(y) or y.min() == y.max():
        return Model({}, 35.0 if len(y) and y[0] else -35.0)
    x = _Rows(rows, None, len(names))
    diff = [(sorted(set(a) - set(b)), sorted(set(b) - set(a))) for a, b in pairs]
    d = _Rows([[*a, *b] for a, b in diff], [[1.0] * len(a) + [-1.0] * len(b) for a, b in diff], len(names))
    w, b = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean())))
    share = np.where(y > 0, TOXIC, 1.0)
    share /= share.sum()
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -35, 35)))
        off = (p - y) * share
        g = x.back(off) + RIDGE * w
        if d.n:
            g += counterfactual * d.back(d.times(w)) / d.n
        gb = float(off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model({n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 1e-6}, b)


def _vocabulary(sample: DataFrame, most: int) -> list[str]:
    """The tokens whose presence tells most of the label (G-test of documents with and without), counted on the
    executors; the most telling ones alone come to the driver. Identity terms are always among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[y].update(tokens(text or ""))
            if len(count[0]) + len(count[1]) > 500_000:  # what has been counted goes on, memory stays bounded
                yield _counts(count)
                count = (Counter(), Counter())
        yield _counts(count)

    def _counts(count: tuple[Counter, Counter]) -> pa.RecordBatch:
        both = sorted(count[0].keys() | count[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([c[t] for t in both], pa.int64()) for c in count)], ["token", "clean", "toxic"])

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = float(n.get(0, 0)), float(n.get(1, 0))
    if not n0 or not n1:
        return []
    counted = sample.mapInArrow(run, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    all_of = F.col("clean") + F.col("toxic")

    def term(o, e):
        return F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))

    rate1, rate0 = F.lit(n1 / (n0 + n1)), F.lit(n0 / (n0 + n1))
    gain = term(F.col("toxic"), all_of * rate1) + term(F.col("clean"), all_of * rate0)
    rest = F.lit(n0 + n1) - all_of
    gain = gain + term(F.lit(n1) - F.col("toxic"), rest * rate1) + term(F.lit(n0) - F.col("clean"), rest * rate0)
    best = counted.filter((all_of >= 3) & (rest > 0)).select("token", F.round(gain, 9).alias("gain")).filter(F.col("gain") >= EVIDENCE).orderBy(F.desc("gain"), "token").limit(most)
    return sorted({r["token"] for r in best.collect()} | set(SWAP))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE, most: int = FEATURES) -> Model:
    """Learned from labels.toxic of documents whose crc32 modulo 5 isn't 0, texts alone."""
    sample = labelled_sample(docs, labels, "toxic", 5, 0, limit, id_col, text_col)
    names = _vocabulary(sample, most)
    at = {t: i for i, t in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, rows, others, ys = [], [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = lambda t: sorted(at[x] for x in at.keys() & t)
                sides = [(0, tokens(text or ""), set()), *((1, a, b) for a, b in counterfactuals(text or ""))]
                for kind, a, b in sides:
                    kinds.append(kind)
                    rows.append(of(a))
                    others.append(of(b))
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(rows, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.int32())), pa.array(ys, pa.int32())], ["kind", "row", "other", "y"])

    found = sorted((r["kind"], r["row"], r["other"], r["y"]) for r in sample.mapInArrow(run, "kind int, row array<int>, other array<int>, y int").collect())
    rows = [(r, y) for k, r, _, y in found if k == 0]
    return train([r for r, _ in rows], np.array([float(y) for _, y in rows]), [(a, b) for k, a, b, _ in found if k == 1], names)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted of each row of docs. Null text counts as empty. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    scored = rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, score double")
    return scored.select(F.col("id").alias(id_col), (part_of(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
