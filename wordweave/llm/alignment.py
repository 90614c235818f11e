"""Alignment of two tokenizers over the same text.

Both encode a text with a space before it: the one by byte pairs of the tokenizers
library, the other by pieces of the sentencepiece library, which adds the
space itself. Each gives the span of a token, in characters and in bytes of the
text. These are coarse cuts: tokens that share a character have the same span, and
pieces that stand for single bytes have an empty one. There the decoded bytes of
the tokens give the end. Where a token of both ends, a group ends.

Neither tokenizer joins anything over a single space between two other characters,
so a text is cut there into units. The alignment of a unit does not depend on its
company; it is remembered within a task, in a table of bounded size, and new units
are encoded many at a time.

Two tokens that end together end with the same bytes, so one is a suffix of the
other. All pairs of ids that can be linked are known from the vocabularies, a
third of a million: they are numbered, and what the corpus counts of them is small.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from wordweave.session import Scratch, cut

# The space mark of pieces and the type of byte pieces.
SPACE, BYTE = "▁", 6

# A single space between two characters that are none.
UNIT = re.compile(r"(?<=\S) (?=\S)")

# Bytes of texts and characters of new units taken at a time; units remembered, twice
# at most, and the length of such a unit.
TEXTS, NEW, UNITS, UNIT_LENGTH = 1 << 19, 1 << 16, 120_000, 48


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: itself where it has one, else the next of those from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both models, the bytes of their tokens and the numbered pairs that can
    be linked. It travels to the tasks, which need no model file."""

    def __init__(self, byte_model: str, piece_model: str):
        alphabet = _byte_alphabet()
        self.byte_model = Path(byte_model).read_text()
        self.piece_model = Path(piece_model).read_bytes()
        self.digest = hashlib.sha256(self.byte_model.encode() + self.piece_model).hexdigest()
        model = json.loads(self.byte_model)
        splits = model["pre_tokenizer"] or {}
        if splits.get("type") != "ByteLevel" or not splits.get("use_regex", True) or model["normalizer"]:
            raise ValueError("the first model has to split words at spaces, byte by byte")
        vocabulary = model["model"]["vocab"]
        self.a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # A special token is plain text here and made of other tokens.
            self.a[i] = bytes(alphabet[c] for c in token) if set(token) <= alphabet.keys() else b""
        pieces = sentencepiece_model_pb2.ModelProto.FromString(self.piece_model).pieces
        if any(SPACE in p.piece.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of the second model goes on after a space")
        self.b = [
            bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode()
            for p in pieces
        ]
        # In ascending order, the first id in the upper half.
        self.pairs = np.array(sorted((i << 32) | j for i, j in self._linkable()), np.int64)

    def _linkable(self) -> set[tuple[int, int]]:
        """Ids of tokens of which one is a suffix of the other."""
        by_bytes: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        for ids, tokens in zip(by_bytes, (self.a, self.b)):
            for i, token in enumerate(tokens):
                ids[token].append(i)
        found = set()
        for i, token in enumerate(self.a):
            for at in range(len(token)):
                found.update((i, j) for j in by_bytes[1].get(token[at:], ()))
        for j, token in enumerate(self.b):
            for at in range(len(token)):
                found.update((i, j) for i in by_bytes[0].get(token[at:], ()))
        return found


class Aligner:
    """Aligns texts; one per worker, which keeps the units it has met, with the
    ends of their groups if ``spans`` are wanted."""

    def __init__(self, words: Vocabularies, spans: bool = True):
        self.spans = spans
        self.first = Tokenizer.from_str(words.byte_model)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=words.piece_model)
        self.a, self.b, self.pairs = words.a, words.b, words.pairs
        self.sizes = [np.array(list(map(len, v))) for v in (self.a, self.b)]
        # Ids as text, with what follows them inside a group and at its border.
        self.texts = [
            (np.array([f"{i}," for i in range(len(v))], object), np.array([f"{i}{mark}" for i in range(len(v))], object))
            for v, mark in ((self.a, "|"), (self.b, ";"))
        ]
        self.digits = [np.array(list(map(len, t[0]))) for t in self.texts]
        self.now: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def first_ends(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and byte ends in a text by the first tokenizer."""
        coded = self.first.encode(text, add_special_tokens=False)
        ids = coded.ids
        spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        byte_at = np.zeros(len(text) + 1, np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at[1:] = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        # A token that shares its last character with the next ends inside it.
        sure = np.r_[spans[1:, 0] >= spans[:-1, 1], True] if len(ids) else np.empty(0, bool)
        return ids, self._refined(byte_at[spans[:, 1]], sure, self.sizes[0][ids])

    def second_ends(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and byte ends, in the text with a space before it, by the
        second tokenizer."""
        coded = self.second.encode(text, return_type="proto").pieces
        spans = [(p.id, p.end) for p in coded]
        both = np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)
        ends = both[:, 1] + 1
        # The space added has no span, nor have bytes of a character but one.
        sizes = self.sizes[1][both[:, 0]]
        sure = np.r_[ends[:-1] < ends[1:], True] if len(ends) else np.empty(0, bool)
        sure &= (sizes > 1) | (ends == np.cumsum(sizes))
        return both[:, 0].tolist(), self._refined(ends, sure, sizes)

    @staticmethod
    def _refined(ends: np.ndarray, sure: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ends that are not sure follow from the last sure one before by the
        length of the tokens since."""
        total = np.cumsum(sizes)
        at = np.maximum.accumulate(np.where(sure, np.arange(len(ends)), -1))
        base = np.where(at >= 0, ends[at] - total[at], 0)
        return total + base

    def encode(self, units: list[str]) -> list[tuple | None]:
        """Of each unit its groups, links, numbers of tokens and group ends;
        None where the bytes of its tokens are not its own. Only the last may
        end with a space and only the first may begin with one."""
        text = " ".join(units)
        a, ends_a = self.first_ends(" " + text)
        b, ends_b = self.second_ends(text)
        data = (" " + text).encode()
        if b"".join([self.a[i] for i in a]) != data or b"".join([self.b[i] for i in b]) != data:
            if len(units) == 1:
                return [None]
            half = len(units) // 2
            return self.encode(units[:half]) + self.encode(units[half:])
        common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        a, b = np.array(a), np.array(b)
        links = np.searchsorted(self.pairs, (a[at_a] << 32) | b[at_b]).astype(np.int32)
        # Tokens as text, those of the second behind those of the first, group by group.
        from_a, from_b = np.r_[0, at_a + 1], np.r_[0, at_b + 1]
        row = np.empty(len(a) + len(b), object)
        digits = np.empty(len(row), np.int64)
        for ids, last, starts, other, kind in ((a, at_a, from_a, from_b[:-1], 0), (b, at_b, from_b, from_a[1:], 1)):
            place = np.arange(len(ids)) + np.repeat(other, np.diff(starts))
            written = self.texts[kind][0][ids]
            written[last] = self.texts[kind][1][ids[last]]
            row[place], digits[place] = written, self.digits[kind][ids]
        groups = "".join(row.tolist())
        upto = np.r_[0, np.cumsum(digits)]
        # Units end where groups do.
        stops = np.cumsum([len(u.encode()) + 1 for u in units])
        cut_at = np.r_[0, np.searchsorted(common, stops, side="right")]
        chars = upto[from_a[cut_at] + from_b[cut_at]].tolist()
        raw, at = links.tobytes(), (4 * cut_at).tolist()
        n_a, n_b = np.diff(from_a[cut_at]).tolist(), np.diff(from_b[cut_at]).tolist()
        made = [
            (groups[c : d - 1], raw[i:j], x, y) for c, d, i, j, x, y in zip(chars, chars[1:], at, at[1:], n_a, n_b)
        ]
        if self.spans:
            inside = (common - np.repeat(np.r_[0, stops[:-1]], np.diff(cut_at))).astype(np.int32).tobytes()
            made = [(*m, inside[i:j]) for m, i, j in zip(made, at, at[1:])]
        return made

    def _learn(self, new: list[str]) -> dict[str, tuple | None]:
        """Alignments of new units. Those with a space at an end are encoded
        by themselves, and those with a space mark, which are hardly ever kept."""
        made, some, size = {}, [], 0
        for unit in new:
            if unit[0].isspace() or unit[-1].isspace() or SPACE in unit:
                made[unit] = self.encode([unit])[0]
                continue
            some.append(unit)
            size += len(unit)
            if size > NEW:
                made.update(zip(some, self.encode(some)))
                some, size = [], 0
        if some:
            made.update(zip(some, self.encode(some)))
        return made

    def align(self, texts: list[str]) -> list[list[tuple | None]]:
        """The alignments of the units of each text; none for an empty one."""
        units = [UNIT.split(t) if t else [] for t in texts]
        if len(self.now) > UNITS:
            self.before, self.now = self.now, {}
        here, new = {}, []
        for unit in set().union(*units).difference(self.now):
            if unit in self.before:
                self.now[unit] = self.before[unit]
            else:
                new.append(unit)
        # The order of a set is another in each run; that of units changes nothing.
        for unit, found in self._learn(new).items():
            (self.now if len(unit) <= UNIT_LENGTH else here)[unit] = found
        if not here:
            return [list(map(self.now.__getitem__, some)) for some in units]
        return [[self.now[u] if u in self.now else here[u] for u in some] for some in units]


@cache
def _vocabularies(byte_model: str, piece_model: str) -> Vocabularies:
    return Vocabularies(byte_model, piece_model)


# The aligner of this process, by the digest of its models.
_ALIGNER: dict[tuple[str, bool], Aligner] = {}


def _aligner(words: Broadcast, spans: bool) -> Aligner:
    """The aligner of a worker process; the units it knows serve all its
    tasks."""
    key = words.value.digest, spans
    if key not in _ALIGNER:
        _ALIGNER.clear()
        _ALIGNER[key] = Aligner(words.value, spans)
    return _ALIGNER[key]


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with a bounded sum of bytes."""
    first = size = 0
    for at, length in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + length > TEXTS:
            yield first, at
            first, size = at, 0
        size += length
    if first < len(texts):
        yield first, len(texts)


def _rows(found: list[tuple | None], spans: bool) -> tuple:
    """(n_a, n_b, links, groups, ends) of a text from those of its units."""
    if not found or None in found:
        return 0, 0, [], "", []
    groups = ";".join([f[0] for f in found])
    links = np.frombuffer(b"".join([f[1] for f in found]), np.int32)
    ends: np.ndarray | list = []
    if spans:
        parts = [np.frombuffer(f[4], np.int32) for f in found]
        offsets = np.cumsum([0] + [p[-1] for p in parts[:-1]])
        ends = np.concatenate([p.astype(np.int64) + o for p, o in zip(parts, offsets)])
    return sum([f[2] for f in found]), sum([f[3] for f in found]), links, groups, ends


# A column made of the groups and ends of a text: its values and its type.
Result = tuple[Callable[[str, list[int]], object], str]

# The real outputs, as they are.
OUTPUTS: dict[str, Result] = {
    "groups": (lambda groups, ends: groups, "string"),
    "ends": (lambda groups, ends: ends, "array<bigint>"),
}


def alignments(
    docs: DataFrame,
    byte_model: str,
    piece_model: str,
    kept: list[str] | None = None,
    text: str = "text",
    results: dict[str, Result] | None = None,
    spans: bool = True,
) -> DataFrame:
    """Adds to the columns ``kept`` n_a, n_b, links and ``results``.

    Results are made of ``groups``, the ids of both tokenizers as text,
    ``a1,a2|b1;a3|b2,b3``, and ``ends``, the byte in the text, with a space before
    it, where each group ends (none with ``spans`` False); by default they are these
    two. They are made where the text is aligned, so that a digest of the
    groups, which are several times as long as the text, costs no more than itself.
    ``links`` holds the number of each linked pair of ids in
    ``Vocabularies.pairs``. A text that is NULL or empty, or one whose bytes either
    tokenizer does not keep, has no tokens, '' and empty arrays. Long texts are
    aligned whole. One row per row.
    """
    kept = ["doc_id"] if kept is None else kept
    results = OUTPUTS if results is None else results
    words = docs.sparkSession.sparkContext.broadcast(_vocabularies(byte_model, piece_model))
    made_of = [make for make, _ in results.values()]
    arrow = [to_arrow_type(T.DataType.fromDDL(kind)) for _, kind in results.values()]
    names = [*kept, "n_a", "n_b", "links", *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(words, spans)
        for batch in batches:
            column = batch.column(len(kept))
            for lo, hi in _portions(column):
                texts = [x or "" for x in column.slice(lo, hi - lo).to_pylist()]
                a, b, links, *made = [], [], [], *[[] for _ in made_of]
                for found in aligner.align(texts):
                    n_a, n_b, own, groups, ends = _rows(found, spans)
                    a.append(n_a)
                    b.append(n_b)
                    links.append(own)
                    for values, make in zip(made, made_of):
                        values.append(make(groups, ends))
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                arrays += [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.list_(pa.int32()))]
                arrays += [pa.array(values, kind) for values, kind in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    types = dict(docs.dtypes)
    head = "".join(f"`{c}` {types[c]}, " for c in kept)
    tail = "".join(f", `{name}` {kind}" for name, (_, kind) in results.items())
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))
    return source.mapInArrow(run, f"{head}n_a bigint, n_b bigint, links array<int>{tail}")


def pair_counts(aligned_docs: DataFrame, words: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    """Of each numbered pair how many links hold it, and whether that is the
    most of its second id. The size is that of the vocabularies."""
    pairs = words.pairs & 0xFFFFFFFF
    rows = aligned_docs.select(F.explode("links").alias("pair")).groupBy("pair").count().toArrow()
    counts = np.zeros(len(pairs), np.int64)
    counts[rows["pair"].to_numpy()] = rows["count"].to_numpy()
    most = np.zeros(len(words.b), np.int64)
    np.maximum.at(most, pairs, counts)
    return counts, counts == most[pairs]


def aligned(
    docs: DataFrame,
    byte_model: str,
    piece_model: str,
    kept: list[str] | None = None,
    text: str = "text",
    results: dict[str, Result] | None = None,
    spans: bool = True,
) -> DataFrame:
    """The columns ``kept`` (doc_id) with n_a, n_b, n_groups, n_links, n_best,
    count_sum and ``results`` as in ``alignments``, by default groups and ends.

    A link is a token of each tokenizer that end together; ``n_best`` counts those
    whose pair of ids is linked most often of all with that second id in the whole
    corpus, ties included, ``count_sum`` adds up how often the pairs are linked in
    it. Texts without tokens (NULL, empty, or bytes not kept) have zeros. Repeated
    rows count as often as they occur; an empty table gives no rows. Other columns
    are not read.
    """
    kept = ["doc_id"] if kept is None else kept
    results = OUTPUTS if results is None else results
    words = _vocabularies(byte_model, piece_model)
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.keep(alignments(docs, byte_model, piece_model, kept, text, results, spans))
        tables = spark.sparkContext.broadcast(pair_counts(rows, words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, best = tables.value
            for batch in batches:
                links = batch.column("links")
                sizes = links.value_lengths().to_numpy()
                flat = links.flatten().to_numpy()
                ends = np.cumsum(sizes)

                def sums(values: np.ndarray) -> pa.Array:
                    total = np.r_[0, np.cumsum(values)]
                    return pa.array(total[ends] - total[ends - sizes], pa.int64())

                added = [pa.array(sizes, pa.int64()), sums(best[flat]), sums(counts[flat])]
                columns = [batch.column(c) for c in heads] + added + [batch.column(c) for c in tails]
                yield pa.RecordBatch.from_arrays(columns, [*heads, "n_links", "n_best", "count_sum", *tails])

        heads, tails = [*kept, "n_a", "n_b"], list(results)
        types = dict(rows.dtypes)
        schema = ", ".join(f"`{c}` {types[c]}" for c in heads)
        tail = "".join(f", `{c}` {types[c]}" for c in tails)
        scored = rows.mapInArrow(run, f"{schema}, n_links bigint, n_best bigint, count_sum bigint{tail}")
        # Tokens are never empty, so a group ends with exactly one link.
        result = cut(scored.withColumn("n_groups", F.col("n_links")))
        tables.destroy()
        return result
