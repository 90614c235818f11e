"""Language by prediction by partial matching.

Per language a variable-order byte context tree is counted over all training
texts and then frozen. The code length of a byte is that of its longest known
context; a byte the context has not seen costs the escape of the context and is
coded by the next shorter one, down to a uniform code of eight bits. With n
bytes seen in a context, t of them different, a byte seen c times has
probability c / (n + t) and the escape t / (n + t). The language with the
shortest code wins.

Words are coded one by one, each with a space before and after it, and contexts
reach back to the space before the word. So the code of a text is the sum over
its words, a word is coded once per task, and the counts are those of distinct
words times their frequency.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.llm.common import WORDS, fold, text_map
from wordweave.session import Scratch, cut

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"

# Longest context in bytes; a gram of a context and a byte is one integer.
ORDER = 3

# Nodes of the trees of all languages that travel to the tasks at once, about:
# 16 bytes each. Larger trees go in several passes, see ``language``.
NODES = 4_000_000

# Entries of the tables a task keeps.
WORDS_KEPT = 250_000

DIGITS = bytes.maketrans(b"0123456789", b" " * 10)


def words_of(text: str) -> list[bytes]:
    """Runs of letters: A-Z lower-cased, other ASCII cut, the rest kept."""
    return text.encode().translate(WORDS).translate(DIGITS).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of the words and for the space after each: the last four
    bytes up to it as one integer, how many of them before it belong to its
    word (the space in front included), and the number of the word."""
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes  # first byte of each word
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    depth = np.arange(1, len(joined)) - starts[owner] + 1
    code = joined[1:].copy()
    for back in range(1, ORDER + 1):
        code[back - 1 :] |= joined[: len(joined) - back] << (8 * back)
    return code, np.minimum(depth, ORDER), owner


def _masked(code: np.ndarray, order: int) -> np.ndarray:
    return code & ((1 << (8 * (order + 1))) - 1)


def _counted(words: Counter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, grams, counts) of words with their frequencies."""
    listed = list(words)
    code, depth, owner = grams(listed)
    weight = np.fromiter(words.values(), np.int64, len(listed))[owner]
    for order in range(ORDER + 1):
        there = depth >= order
        found, at = np.unique(_masked(code[there], order), return_inverse=True)
        yield order, found, np.bincount(at, weight[there]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) -> sums (lang, level, gram, n) per task; words are
    gathered first, in a table of bounded size."""
    held: dict[str, Counter] = {}

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        for order, found, n in _counted(held.pop(lang)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(found)),
                    pa.array(np.full(len(found), order, np.int32)),
                    pa.array(found),
                    pa.array(n),
                ],
                ["lang", "level", "gram", "n"],
            )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if words:
                held.setdefault(lang, Counter()).update(words)
                if len(held[lang]) > WORDS_KEPT:
                    yield from flush(lang)
    for lang in list(held):
        yield from flush(lang)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, level, gram, n) over all rows that have both."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    partial = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sums = partial.mapInArrow(_count, "lang string, level int, gram bigint, n bigint")
    return sums.groupBy("lang", "level", "gram").agg(F.sum("n").alias("n"))


def _runs(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that look up ``at`` in runs of equal ``keys`` numbers: the row
    and the place of every entry of its run."""
    starts = np.searchsorted(keys, at)
    sizes = np.searchsorted(keys, at, side="right") - starts
    row = np.repeat(np.arange(len(at)), sizes)
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, starts[row] + offset


class Trees:
    """Frozen trees of all languages. Per level one entry per gram and language
    that has it, with its code length, and one per context and language, with the
    escape length; both in the order of grams. ``bytes_before`` says for which bytes
    before the coded one they are made."""

    def __init__(
        self,
        langs: list[str],
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
        bytes_before: np.ndarray | None = None,
        parts: int = 1,
    ):
        """``rows``: per level the language numbers, grams and counts; ``parts``
        is how many such trees there are in all."""
        self.langs, self.levels, self.parts = langs, [], parts
        self.here = np.ones(256, bool) if bytes_before is None else bytes_before
        for lang, gram, n in rows:
            order = np.lexsort((lang, gram))
            lang, gram, n = lang[order], gram[order], n[order]
            context = (gram >> 8) * len(langs) + lang
            known, under, kinds = np.unique(context, return_inverse=True, return_counts=True)
            whole = np.bincount(under, n, len(known)) + kinds
            bits = -np.log2(n / whole[under])
            escape = -np.log2(kinds / whole)
            self.levels.append(
                (gram, lang.astype(np.int32), bits, known // len(langs), (known % len(langs)).astype(np.int32), escape)
            )

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Code length in bits, one row per word and one column per language,
        of the bytes after one of ``bytes_before``."""
        code, depth, owner = grams(words)
        here = self.here[(code >> 8) & 255]
        code, depth, owner = code[here], depth[here], owner[here]
        cost = np.full((len(code), len(self.langs)), 8.0)
        for order, (gram, lang, bits, context, its, escape) in enumerate(self.levels):
            there = np.flatnonzero(depth >= order)
            asked = _masked(code[there], order)
            row, at = _runs(context, asked >> 8)
            cost[there[row], its[at]] += escape[at]
            row, at = _runs(gram, asked)
            cost[there[row], lang[at]] = bits[at]
        out = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, cost[:, k], len(words))
        return out


class _Lengths:
    def __init__(self, trees: Trees):
        self.trees = trees

    def __call__(self, texts: list[str]) -> dict[str, object]:
        """Whether a text has a letter, and its code length in each language. Words are numbered in
        a table that lives as long as the task and is begun anew when it is full;
        their code lengths are rows of a matrix."""
        split = [words_of(t) for t in texts]
        index = self.__dict__.setdefault("index", {})
        if len(index) > WORDS_KEPT:
            index.clear()
        if not index:
            self.matrix = np.zeros((0, len(self.trees.langs)))
        rows, letters = [], [any(map(str.isalpha, t)) for t in texts]
        for lo in range(0, len(texts), 256):
            part = split[lo : lo + 256]
            new = list(set().union(*part).difference(index))
            if new and self.trees.langs:
                begun = len(index)
                index.update(zip(new, range(begun, begun + len(new))))
                self.matrix = self._grown(begun, self.trees.lengths(new))
            for words in part:
                at = np.fromiter(map(index.__getitem__, words), np.int64, len(words)) if self.trees.langs else []
                rows.append(self.matrix[at].sum(axis=0))
        return {"letters": pa.array(letters), "bits": pa.array(rows, pa.list_(pa.float64()))}

    def _grown(self, begun: int, rows: np.ndarray) -> np.ndarray:
        """The matrix with ``rows`` from row ``begun`` on; room doubles."""
        matrix = self.matrix
        if begun + len(rows) > len(matrix):
            wider = np.zeros((2 * (begun + len(rows)), matrix.shape[1]))
            wider[:begun] = matrix[:begun]
            matrix = wider
        matrix[begun : begun + len(rows)] = rows
        return matrix


class _Best:
    """The language with the shortest code of (text, bits)."""

    def __init__(self, langs: list[str]):
        self.langs = langs

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for letters, bits in zip(batch.column(1).to_pylist(), batch.column(2)):
                if not self.langs or not letters:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bits = bits.values.to_numpy()
                best = int(bits.argmin())
                langs.append(self.langs[best])
                scores.append(float(1.0 / np.exp2(np.minimum(bits[best] - bits, 0.0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )


def _groups(sizes: dict[int, int]) -> list[list[int]]:
    """Bytes in groups of at most ``NODES`` nodes, or a single byte each."""
    groups: list[list[int]] = [[]]
    held = 0
    for byte in range(256):
        if groups[-1] and held + sizes.get(byte, 0) > NODES:
            groups.append([])
            held = 0
        groups[-1].append(byte)
        held += sizes.get(byte, 0)
    return groups


def trained(table: DataFrame) -> Iterator[Trees]:
    """The frozen trees of stored counts (lang, level, gram, n), in parts.

    Everything that the code of a byte asks for, grams and contexts of all levels,
    has the same byte before it, so trees may be cut by that byte: the code length of
    a text is the sum over the parts. Level 0 has no byte before and is in all.
    """
    langs = sorted(r[0] for r in table.select("lang").distinct().collect())
    number = {name: i for i, name in enumerate(langs)}
    before = F.when(F.col("level") > 0, F.shiftright("gram", 8).bitwiseAND(F.lit(255).cast("long")))
    sizes = {r["before"]: r["count"] for r in table.groupBy(before.alias("before")).count().collect()}
    groups = _groups(sizes)
    for group in groups:
        here = np.isin(np.arange(256), group)
        nodes = table.where(before.isNull() | before.isin(group)).toArrow()
        level, gram, n = (nodes.column(c).to_numpy() for c in ("level", "gram", "n"))
        lang = np.array([number[x] for x in nodes.column("lang").to_pylist()], np.int64)
        rows = [tuple(x[level == k] for x in (lang, gram, n)) for k in range(ORDER + 1)]
        yield Trees(langs, rows if langs else [], here, len(groups))


def language(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row.

    Learns from text and language of the rows whose fold is not the held-out
    one, and predicts from the text alone. ``score`` is the share of the
    winner's probability among the languages. A NULL text or one without a
    letter is ``und`` with score 0, and so is every text if nothing was
    learned. Ties go to the first language in order of name. Repeated rows are
    predicted each and counted each in training; a NULL id belongs to fold 0. Long
    texts are coded whole. An empty table gives no rows; other columns are not read.

    Trees of more than ``NODES`` nodes are cut into parts; each part is one pass
    over the texts, which are carried on with the code lengths so far.
    """
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    learned = plain.where(fold("doc_id", FOLDS) != HELD_OUT)
    kind = dict(plain.dtypes)["doc_id"]
    with Scratch(docs.sparkSession) as scratch:
        table = scratch.keep(counts(learned))
        rows, langs = None, []
        for trees in trained(table):
            langs = trees.langs
            source = plain if rows is None else scratch.keep(rows)
            # The text goes along only where another pass may need it.
            text_again = ["text"] if trees.parts > 1 else []
            kept = ["doc_id", *text_again, *([] if rows is None else ["_sum"])]
            coded = text_map(source, kept, "text", _Lengths(trees), "letters boolean, bits array<double>")
            added = F.col("bits") if rows is None else F.zip_with("_sum", "bits", lambda a, b: a + b)
            rows = coded.select("doc_id", *text_again, "letters", added.alias("_sum"))
        found = rows.select("doc_id", "letters", "_sum").mapInArrow(
            _Best(langs), f"doc_id {kind}, lang_pred string, score double"
        )
        return cut(
            found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
        )
