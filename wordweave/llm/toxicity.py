"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed into buckets: its words and the stems
(first bytes) of longer words, so that forms of a word never seen before still
count. The score adds a weight per bucket and, for every pair of buckets, the
dot product of their factors, so a pair can count for more than its parts: a
group mention beside an insult.

Two screens say which buckets are learned. The first takes those associated with
the label by themselves. A machine of these leaves errors; the second screen looks
at the errors of the rows that hold a bucket together with another one. It takes
pairs that tell much, and, where very many partners of a bucket tell a little each,
those partners: rare words for a group, each seen a few times beside an insult. So a
pair counts also if neither of its parts tells anything alone.

Buckets are learned with adaptive gradient steps. A part of the terms is hidden in
every step, so that a single insult among many learns to count on its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.llm.common import WORDS, bounded, fold, labelled_rows, sigmoid, text_map

FOLDS = 5
THRESHOLD = 0.5

# The model is fitted on at most this many labelled rows, chosen by a hash, of
# at most so many terms each.
TRAINING_ROWS, ROW_TERMS = 10_000, 5_000

BUCKETS, FACTORS = 1 << 20, 6
EPOCHS, BATCH, RATE, DECAY, HIDDEN = 16, 256, 0.3, 2e-5, 0.3

# Bytes of a stem; words of more bytes have one.
STEM = 5

# A bucket is learned if its likelihood ratio statistic reaches this value
# (one degree of freedom, p of about one in ten thousand).
ASSOCIATED = 15.0

# A pair is learned if the square of its summed errors is this many times its
# variance (among some millions of pairs chance hardly gets there); and the partners
# of a bucket if their excess is so many times its standard deviation, from
# ``HINT`` on each. Only so many buckets are looked at for partners, those with the
# largest variance of errors.
PAIRED, DIFFUSE, HINT, PIVOTS = 40.0, 8.0, 1.5, 2_000

# The variance from which on the machine is not sure of a row.
UNSURE = 0.02


def terms(text: str) -> np.ndarray:
    """Sorted buckets of the distinct terms: runs of letters and digits, A-Z
    lower-cased, and their stems; every non-ASCII character counts as a
    letter. A stem ends with a space, which no word has."""
    words = set(text.encode().translate(WORDS).split())
    words.update({w[:STEM] + b" " for w in words if len(w) > STEM})
    made = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    return np.unique(made & np.uint32(BUCKETS - 1)).astype(np.int32)


def _entropy(*counts: np.ndarray) -> np.ndarray:
    total = sum(counts)
    return -sum(c * np.log(np.maximum(c, 1e-12) / np.maximum(total, 1e-12)) for c in counts)


def associated(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets whose presence tells about the label, sorted."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    sizes = [len(r) for r in rows]
    positive = np.bincount(flat, np.repeat(y, sizes), BUCKETS) if len(flat) else np.zeros(BUCKETS)
    present = np.bincount(flat, minlength=BUCKETS) if len(flat) else np.zeros(BUCKETS)
    n, all_positive = len(y), y.sum()
    within = _entropy(positive, present - positive)
    without = _entropy(all_positive - positive, (n - present) - (all_positive - positive))
    whole = _entropy(np.array([float(all_positive)]), np.array([float(n - all_positive)]))
    statistic = 2 * (whole - within - without)
    return np.flatnonzero((statistic >= ASSOCIATED) & (present > 2))


def in_pairs(rows: list[np.ndarray], y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The buckets that tell about the errors y - p in pairs, sorted."""
    error, variance = y - p, p * (1 - p)
    # Rows that the machine is sure of, rightly, have nothing left to tell.
    open_rows = np.flatnonzero((variance > UNSURE) | (np.abs(error) > 0.5))
    rows, error, variance = [rows[i] for i in open_rows], error[open_rows], variance[open_rows]
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    buckets, number, present = np.unique(flat, return_inverse=True, return_counts=True)
    often = present > 2
    owner, number = owner[often[number]], (np.cumsum(often) - 1)[number[often[number]]]
    buckets, present = buckets[often], present[often]
    # Rows of each bucket and buckets of each row, one after the other.
    by_bucket = owner[np.argsort(number, kind="stable")]
    ends = np.cumsum(present)
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    weight = np.bincount(number, variance[owner], len(buckets))
    pivots = np.argsort(-weight, kind="stable")[:PIVOTS]
    found = []
    for pivot in pivots[weight[pivots] >= 1]:
        its = by_bucket[ends[pivot] - present[pivot] : ends[pivot]]
        sizes = starts[its + 1] - starts[its]
        at = np.repeat(starts[its] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        # What the pivot's rows err on the whole is no matter of a partner.
        left = error[its] - variance[its] * (error[its].sum() / variance[its].sum())
        partners = number[at]
        together = np.bincount(partners, minlength=len(buckets))
        total = np.bincount(partners, np.repeat(left, sizes), len(buckets))
        spread = np.bincount(partners, np.repeat(variance[its], sizes), len(buckets))
        together[pivot] = 0
        partner = np.flatnonzero((together > 2) & (spread >= 0.5))
        tells = total[partner] ** 2 / spread[partner]
        strong = tells >= PAIRED
        taken = strong
        if (tells - 1)[~strong].sum() >= DIFFUSE * np.sqrt(2 * max(1, (~strong).sum())):
            taken = tells >= HINT
        if taken.any():
            found += [np.array([pivot]), partner[taken]]
    return buckets[np.unique(np.concatenate(found))] if found else np.empty(0, np.int64)


class Machine:
    """Weights ``w`` and factors ``v`` of the learned buckets."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets.astype(np.int32), bias
        random = np.random.default_rng(7)
        self.w = np.zeros(len(buckets))
        self.v = random.normal(0, 0.05, (len(buckets), FACTORS))

    def known(self, row: np.ndarray) -> np.ndarray:
        """Positions of the learned buckets among the sorted ``row``."""
        if not len(self.buckets):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, row), len(self.buckets) - 1)
        return at[self.buckets[at] == row]

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for i, row in enumerate(rows):
            if len(row):
                v = self.v[row]
                s = v.sum(axis=0)
                out[i] += self.w[row].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.raw(rows))

    def learn(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        random = np.random.default_rng(11)
        grown_w, grown_v, grown_b = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = random.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                batch = [rows[i][random.random(len(rows[i])) >= HIDDEN] for i in some]
                flat = np.concatenate(batch)
                owner = np.repeat(np.arange(len(batch)), [len(r) for r in batch])
                v = self.v[flat]
                sums = np.stack([np.bincount(owner, v[:, k], len(batch)) for k in range(FACTORS)], axis=1)
                own = np.bincount(owner, (v * v).sum(axis=1), len(batch))
                raw = self.bias + np.bincount(owner, self.w[flat], len(batch)) + 0.5 * ((sums * sums).sum(axis=1) - own)
                error = (sigmoid(raw) - y[some]) / len(some)
                gw = np.bincount(flat, error[owner], len(self.w)).astype(float)
                pulled = error[owner][:, None] * (sums[owner] - v)
                gv = np.stack([np.bincount(flat, pulled[:, k], len(self.w)) for k in range(FACTORS)], axis=1).astype(float)
                gw += DECAY * self.w
                gv += DECAY * self.v
                grown_w += gw * gw
                grown_v += gv * gv
                grown_b += error.sum() ** 2
                self.w -= RATE * gw / np.sqrt(grown_w)
                self.v -= RATE * gv / np.sqrt(grown_v)
                self.bias -= RATE * error.sum() / np.sqrt(grown_b)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """Learn from sets of buckets and labels (0 or 1). Without rows of both
    labels the machine is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Machine(np.empty(0, np.int32), bias)
    single = associated(rows, y)
    machine = Machine(single, bias)
    known = [machine.known(r) for r in rows]
    machine.learn(known, y.astype(float))
    both = np.union1d(single, in_pairs(rows, y, machine.scores(known)))
    if len(both) > len(single):
        machine = Machine(both, bias)
        machine.learn([machine.known(r) for r in rows], y.astype(float))
    return machine


class _Terms:
    def __call__(self, texts: list[str]) -> dict[str, object]:
        return {"terms": pa.array([terms(t) for t in texts], pa.list_(pa.int32()))}


class _Scores:
    def __init__(self, machine: Machine):
        self.machine = machine

    def __call__(self, texts: list[str]) -> dict[str, object]:
        rows = [self.machine.known(terms(t)) for t in texts]
        return {"score": pa.array(self.machine.scores(rows))}


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row.

    Learns ``labels.toxic`` from rows outside fold 0, at most ``TRAINING_ROWS``
    of at most ``ROW_TERMS`` terms; equal sets of terms count once per label, so
    copies do not weigh more. Every row is scored by its whole text, however long.
    NULL texts count as empty and
    get the score of a text without learned terms. Without labels of both kinds
    every score is the smoothed share of label 1. Repeated rows are scored
    each; a NULL id is held out. An empty table gives no rows; other columns
    are not read.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = labelled_rows(
        plain, labels.withColumnRenamed(doc_id, "doc_id"), "toxic", "doc_id", FOLDS, TRAINING_ROWS
    )
    sets = text_map(marked, ["_y"], "text", _Terms(), "terms array<int>")
    sample = bounded(sets.where(F.size("terms") <= ROW_TERMS).distinct(), TRAINING_ROWS).toArrow()
    lists = sample.column("terms").combine_chunks()
    rows = np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1]) if len(lists) else []
    y = np.array(sample.column("_y").to_pylist(), dtype=int)
    order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i].tobytes()))
    machine = fit([rows[i] for i in order], y[order])
    scored = text_map(plain, ["doc_id"], "text", _Scores(machine), "score double")
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
