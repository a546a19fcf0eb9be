"""Quality as a generalised additive model with pairwise interactions.

Every feature is cut into bins, and shallow trees over one feature's bins are boosted in turn, feature by feature
and round by round, each at a small step; their sums are one lookup table per feature. Then the pairs of features
whose joint bins explain most of what is left get tables of their own in the same way. A score is the logistic
function of the sum of a document's table entries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled documents that are learned from, in expectation: a sample by a hash of the id.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, STEP, RIDGE, LEAST = 32, 8, 6, 120, 60, 0.1, 5.0, 20
#: A score from here on counts as good.
THRESHOLD = 0.7

NAMES = (
    "log_chars", "log_words", "word_length", "symbols", "marks", "bars", "capitals", "digits", "breaks", "line_length",
    "repeated_lines", "different_words", "commonest_word", "short_words", "closed_lines", "marked_words", "other_bytes", "repeated_halves",
)
_SYMBOLS, _MARKS, _UPPER, _DIGITS, _ENDS = b"#$%&*+=<>{}[]~^@\\/_", b"!?", bytes(range(65, 91)), bytes(range(48, 58)), (".", "!", "?", '"', ":", ";")
_ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_HIGH = bytes(range(128, 256))


def features(text: str) -> list[float]:
    """Of the whole text. An empty one has zeros."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    share = lambda of: (len(raw) - len(raw.translate(None, of))) / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    different = set(words)
    n = len(words)
    letters = len(raw) - len(raw.translate(None, _ASCII_LETTERS))
    half = words[: n // 2]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        math.log1p(len(raw)),
        math.log1p(n),
        len(raw) / n,
        share(_SYMBOLS),
        share(_MARKS),
        share(b"|"),
        share(_UPPER) * len(raw) / max(1, letters),
        share(_DIGITS),
        share(b"\n"),
        math.log1p(len(raw) / len(lines)),
        1 - len(set(lines)) / len(lines),
        len(different) / n,
        max(counts.values()) / n,
        sum(map((3).__ge__, map(len, words))) / n,
        sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines),
        sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in words) / n,
        share(_HIGH),
        len(set(half) & set(words[n // 2 :])) / max(1, len(set(half))),
    ]


@dataclass
class Additive:
    """Tables of a trained model. edges[f] cut feature f into bins; pairs holds (f, g, edges f, edges g, table)."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for f, g, of_f, of_g, table in self.pairs:
            total += table[np.searchsorted(of_f, x[:, f], "right"), np.searchsorted(of_g, x[:, g], "right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step of a tree of that depth over a row of bins with gradient, curvature and number."""
    out = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= LEAST) & (nr >= LEAST), gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE), -1.0)
    if gain.max() <= g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
        return out
    cut = int(gain.argmax()) + 1
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree that cuts both features once, over a grid of bins."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    whole_g, whole_h = cg[-1, -1], ch[-1, -1]
    if g.shape[0] < 2 or g.shape[1] < 2:
        return 0.0, np.zeros_like(g)

    def four(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return [a, b, d, c[-1, -1] - a - b - d]

    parts = list(zip(four(cg), four(ch), strict=True))
    gain = sum(x**2 / (y + RIDGE) for x, y in parts) - whole_g**2 / (whole_h + RIDGE)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.empty_like(g)
    values = [x[i, j] / (y[i, j] + RIDGE) for x, y in parts]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), step


def train(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS) -> Additive:
    """y is 0 or 1. Of one kind alone, or of no rows, nothing is learned: scores are the mean, or 1."""
    if not len(y) or y.min() == y.max():
        return Additive(intercept=35.0 if not len(y) or y[0] else -35.0)
    model = Additive(intercept=float(np.log(y.mean() / (1 - y.mean()))))
    k = x.shape[1]
    model.edges = [_edges(x[:, f], BINS) for f in range(k)]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    numbers = [np.bincount(a, minlength=len(t)) for a, t in zip(at, model.tables, strict=True)]
    logits = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logits))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            size = len(model.tables[f])
            step = STEP * _tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), numbers[f])
            model.tables[f] += step
            logits += step[at[f]]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(k)]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grid(f: int, o: int, weights: np.ndarray) -> np.ndarray:
        a, b = len(coarse[f]) + 1, len(coarse[o]) + 1
        return np.bincount(at[f] * b + at[o], weights, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(((-_quadrants(grid(f, o, g), grid(f, o, h))[0], f, o) for f, o in combinations(range(k), 2)))[:pairs]
    tables = {(f, o): np.zeros((len(coarse[f]) + 1, len(coarse[o]) + 1)) for _, f, o in ranked}
    for _ in range(pair_rounds):
        for (f, o), table in tables.items():
            g, h = slopes()
            step = STEP * _quadrants(grid(f, o, g), grid(f, o, h))[1]
            table += step
            logits += step[at[f], at[o]]
    model.pairs = [(f, o, coarse[f], coarse[o], t) for (f, o), t in tables.items()]
    for f, table in enumerate(model.tables):  # tables without a mean of their own: the intercept has them all
        mean = float(table[np.searchsorted(model.edges[f], x[:, f], "right")].mean())
        table -= mean
        model.intercept += mean
    return model


def part_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, limit: int, id_col: str, text_col: str) -> DataFrame:
    """text and y of labelled documents outside the held-out part; about limit of them, by a hash of the id.

    The sample of labels is what is broadcast: limit, a parameter, bounds it, not the data.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("y")).filter(F.col("y").isNotNull() & F.col("_id").isNotNull() & (part_of(F.col("_id"), parts) != held))
    n = rows.count()
    share = min(1.0, limit / n) if n else 1.0
    some = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("text", F.col("y").cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> Additive:
    """Learned from labels.quality of documents whose crc32 modulo 4 isn't 2, texts alone."""
    sample = labelled_sample(docs, labels, "quality", 4, 2, limit, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sorted((r["x"], r["y"]) for r in sample.mapInArrow(run, "x array<double>, y int").collect())
    return train(np.array([x for x, _ in rows]).reshape(len(rows), len(NAMES)), np.array([float(y) for _, y in rows]))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted of each row of docs. Null text counts as empty. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    scored = rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, score double")
    return scored.select(F.col("id").alias(id_col), (part_of(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Additive, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, schema)
