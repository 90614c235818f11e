"""Document quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn, one feature after the other, so that each
feature ends with one lookup table over its bins; the pairs with the largest
remaining gain get two-dimensional tables in the same way. A score is a sum of
table entries, looked up for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.llm.common import bounded, fold, labelled_rows, portions, sigmoid, text_map

FOLDS = 5
THRESHOLD = 0.3

# The model is fitted on at most this many labelled rows, chosen by a hash of
# the id.
TRAINING_ROWS = 20_000

BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 8, 120, 0.15
LEAST_WEIGHT = 2.0

FEATURES = (
    "bytes words word_length longest upper lower digits blank lines commas stops exclamation bars "
    "symbols brackets quotes other_bytes distinct_words distinct_lines mixed_words entropy"
).split()


def _classes() -> np.ndarray:
    """256 x k: which byte counts for which share."""
    groups = [
        bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t", b"\n\r",
        b",;:", b".", b"!?", b"|", b"#$%&*+<=>@^~", b"()[]{}", b"\"'`", bytes(range(128, 256)),
    ]
    table = np.zeros((256, len(groups)))
    for k, group in enumerate(groups):
        table[list(group), k] = 1
    return table


CLASSES = _classes()


def byte_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(256, np.int64)
    view = np.frombuffer(data, np.uint8)
    for at in range(0, len(view), 1 << 20):
        counts += np.bincount(view[at : at + (1 << 20)], minlength=256)
    return counts


def features(texts: list[str]) -> np.ndarray:
    """One row of numbers per text; an empty text has zeros."""
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 7))
    for i, text in enumerate(texts):
        data = text.encode()
        counts[i] = byte_counts(data)
        words, lines = data.split(), data.split(b"\n")
        if words:
            n, distinct = len(words), set(words)
            mixed = sum(not w[-1:].isalpha() and w[-1] < 128 for w in distinct)
            rest[i] = (
                n, len(data) / n, max(map(len, distinct)), len(distinct) / n,
                len(set(lines)) / len(lines), mixed / len(distinct), len(data),
            )
    total = np.maximum(counts.sum(axis=1), 1)
    share = counts / total[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    n, length, longest, distinct, lines, mixed, size = rest.T
    return np.column_stack(
        [np.log1p(size), np.log1p(n), length, np.log1p(longest), share @ CLASSES, distinct, lines, mixed, entropy]
    )


@dataclass
class Model:
    """Lookup tables. ``edges[f]`` are the bin borders of feature f."""

    prior: float
    edges: list[np.ndarray]
    tables: np.ndarray = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        if self.tables is None:
            return sigmoid(total)
        bins = self.bins(x)
        total += self.tables[np.arange(len(self.edges)), bins].sum(axis=1)
        for p, (f, g) in enumerate(self.pairs):
            total += self.pair_tables[p][coarse(bins[:, f]), coarse(bins[:, g])]
        return sigmoid(total)


def coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def _gain(g, h):
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Update of a one-dimensional table by a tree of at most three leaves on
    the sums of gradients and weights per bin."""
    out = np.zeros(len(g))
    spans = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for lo, hi in spans:
            left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            if not len(left_g):
                continue
            all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
            won = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            won[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
            at = int(won.argmax())
            if won[at] > best[0]:
                best = (won[at], (lo, hi), lo + at + 1)
        if best[1] is None:
            break
        lo, hi = best[1]
        spans.remove((lo, hi))
        spans += [(lo, best[2]), (best[2], hi)]
    for lo, hi in spans:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Update of a two-dimensional table by a tree of four leaves: one cut in
    the first feature, then one in the second on each side; and its gain."""
    best, out = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum())
    for cut_at in range(1, g.shape[0]):
        gain, leaves = -whole, []
        for lo, hi in ((0, cut_at), (cut_at, g.shape[0])):
            side_g, side_h = g[lo:hi].sum(axis=0), h[lo:hi].sum(axis=0)
            left_g, left_h = np.cumsum(side_g)[:-1], np.cumsum(side_h)[:-1]
            right_g, right_h = side_g.sum() - left_g, side_h.sum() - left_h
            won = _gain(left_g, left_h) + _gain(right_g, right_h)
            at = int(won.argmax())
            gain += won[at]
            leaves.append((lo, hi, at + 1, left_g[at] / (left_h[at] + 1), right_g[at] / (right_h[at] + 1)))
        if gain > best:
            best, out = gain, np.zeros_like(g)
            for lo, hi, at, left, right in leaves:
                out[lo:hi, :at], out[lo:hi, at:] = left, right
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost on the rows x with labels y (0 or 1). Without rows of both labels
    the model is the prior alone."""
    y = y.astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else []
    model = Model(float(np.log(share / (1 - share))), edges)
    if not len(x) or y.min() == y.max():
        model.edges = []
        return model
    bins = model.bins(x)
    model.tables = np.zeros((len(edges), BINS))
    total = np.full(len(y), model.prior)
    for _ in range(ROUNDS):
        for f in range(len(edges)):
            p = sigmoid(total)
            g = np.bincount(bins[:, f], y - p, BINS)
            h = np.bincount(bins[:, f], p * (1 - p), BINS)
            step = RATE * _shallow_tree(g, h)
            model.tables[f] += step
            total += step[bins[:, f]]
    small = coarse(bins)
    cells = PAIR_BINS * PAIR_BINS

    def sums(f, k, p):
        cell = small[:, f] * PAIR_BINS + small[:, k]
        g = np.bincount(cell, y - p, cells).reshape(PAIR_BINS, PAIR_BINS)
        return g, np.bincount(cell, p * (1 - p), cells).reshape(PAIR_BINS, PAIR_BINS), cell

    p = sigmoid(total)
    found = sorted(
        ((_pair_tree(*sums(f, k, p)[:2])[1], f, k) for f in range(len(edges)) for k in range(f)),
        reverse=True,
    )[:PAIRS]
    model.pairs = [(f, k) for _, f, k in found]
    model.pair_tables = np.zeros((len(found), PAIR_BINS, PAIR_BINS))
    for _ in range(ROUNDS // 2):
        for n, (f, k) in enumerate(model.pairs):
            g, h, cell = sums(f, k, sigmoid(total))
            step = RATE * _pair_tree(g, h)[0]
            model.pair_tables[n] += step
            total += step.ravel()[cell]
    return model


class _Features:
    def __call__(self, texts: list[str]) -> dict[str, object]:
        x = features(texts).astype(np.float32)
        rows = pa.array(x.ravel())
        return {"x": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], rows)}


class _Scores:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, texts: list[str]) -> dict[str, object]:
        return {"score": pa.array(self.model.scores(features(texts).astype(np.float32).astype(float)))}


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model of ``labels.quality``, from at most ``TRAINING_ROWS`` rows
    outside fold 0; a row that is stored many times counts once."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = labelled_rows(
        plain, labels.withColumnRenamed(doc_id, "doc_id"), "quality", "doc_id", FOLDS, TRAINING_ROWS
    )
    sample = text_map(marked, ["_y"], "text", _Features(), "x array<float>").distinct()
    rows = bounded(sample, TRAINING_ROWS).toArrow()
    matrix = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(matrix, np.array(rows.column("_y").to_pylist(), dtype=int))


def quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row.

    Learns ``labels.quality`` from rows outside fold 0, from features of the
    text alone. NULL texts count as empty; empty texts are scored like others, long
    ones by the features of all their words. Without labels of both kinds every score
    is the smoothed share of label 1. Repeated rows are scored each; a NULL id is
    held out. An empty table gives no rows; other columns are not read.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = trained(docs, labels, doc_id, text)
    scored = text_map(plain, ["doc_id"], "text", _Scores(model), "score double")
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns. Each row is
    judged by its own text as it passes, so nothing is joined or shuffled, and
    an id that repeats or is NULL does not matter."""
    model = trained(docs, labels, doc_id, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, at):
                score = _Scores(model)(texts)["score"].to_numpy()
                yield part.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
