"""Token counts under a unigram model, shared over a trie of words.

The best segmentation of a text into pieces maximises the sum of their scores.
No piece goes on after a space, so texts are cut before spaces, and the
distinct words of a batch are put into a trie. The forward score of a node (the
best score of the prefix that ends there, and how many pieces it takes) is
computed once for all words that share the prefix, from the nodes above it; a
word's count is that of its last node.

A model file of the merge kind has ranks instead of probabilities. Its pieces
are taken to follow Zipf's law: the piece of rank r among n has probability
1 / (r * (1 + 1/2 + ... + 1/n)), and its score is the logarithm. Characters
outside the vocabulary cost the smallest score less ten and count one token per
byte, as with byte fallback. Of equal sums the one with the longest last piece
wins.
"""

from __future__ import annotations

import math
import re
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from wordweave.llm.common import text_map

SPACE = "▁"
NORMAL = 1
UNKNOWN_PENALTY = 10.0

# Nodes of a task's trie, after which it starts anew, and words in its table,
# after which a new one starts and the old one is still asked.
NODES, WORDS_KEPT = 2_000_000, 250_000

# Longer words are not kept after they are counted.
WORD_LENGTH = 64


def zipf_scores(proto: sentencepiece_model_pb2.ModelProto) -> dict[str, float]:
    """Log-probability of each normal piece by its rank in the file."""
    pieces = [p.piece for p in proto.pieces if p.type == NORMAL]
    total = sum(1 / r for r in range(1, len(pieces) + 1))
    return {p: -math.log(r * total) for r, p in enumerate(pieces, 1)}


class Trie:
    """Forward scores of all prefixes met so far.

    Nodes are numbers: ``edges`` leads from a node and a character to the next
    node, ``best`` and ``tokens`` hold its forward score and token count.
    Pieces are looked up backwards from a node's last character, in a second
    trie of their reversed characters, which ends as soon as no piece can.
    """

    def __init__(self, payload: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(payload)
        self.score = zipf_scores(proto)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("the model has pieces that go on after a space")
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.reversed: dict = {}
        for piece, score in self.score.items():
            at = self.reversed
            for char in reversed(piece):
                at = at.setdefault(char, {})
            at[""] = score
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.counts: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def _forward(self, word: str, at: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Forward score and tokens of the prefix up to ``at`` from those of
        the prefixes before it."""
        best, tokens = None, 0
        pieces, begin = self.reversed, at
        while begin >= 0:
            pieces = pieces.get(word[begin])
            if pieces is None:
                break
            score = pieces.get("")
            if score is not None:
                total = scores[begin] + score
                if best is None or total >= best:  # longer ones come later
                    best, tokens = total, counts[begin] + 1
            begin -= 1
        char = word[at]
        if char not in self.score:
            total = scores[at] + self.unknown
            if best is None or total > best:
                best, tokens = total, counts[at] + len(char.encode())
        return best, tokens

    def insert(self, word: str) -> int:
        """The number of tokens of a word; prefixes already there are shared."""
        node, scores, counts = 0, [0.0], [0]
        for at, char in enumerate(word):
            key = node << 21 | ord(char)
            below = self.edges.get(key) if at < WORD_LENGTH else None
            if below is None:
                best, tokens = self._forward(word, at, scores, counts)
                if at < WORD_LENGTH:
                    node = self.edges[key] = len(self.best)
                    self.best.append(best)
                    self.tokens.append(tokens)
            else:
                node, best, tokens = below, self.best[below], self.tokens[below]
            scores.append(best)
            counts.append(tokens)
        return counts[-1]

    def _count_word(self, word: str) -> int:
        found = self.before.get(word)
        if found is None:
            found = self.insert(word)
        if len(word) <= WORD_LENGTH:
            self.counts[word] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a text, without begin and end."""
        if not text:
            return 0
        if len(self.best) > NODES:
            self.clear()
        if len(self.counts) > WORDS_KEPT:
            self.before, self.counts = self.counts, {}
        known, total = self.counts.get, 0
        for word in self.words.findall(SPACE + text.replace(" ", SPACE)):
            found = known(word)
            total += self._count_word(word) if found is None else found
        return total


@cache
def _loaded(payload: bytes) -> Trie:
    return Trie(payload)


class _Counts:
    def __init__(self, payload: bytes):
        self.payload = payload

    def __call__(self, texts: list[str]) -> dict[str, object]:
        trie = _loaded(self.payload)
        return {"n_tokens": pa.array([trie.count(t) for t in texts], pa.int64())}


def token_counts(
    docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens), one row per row, over whole texts.

    ``model`` is the path of a model file on the driver. NULL and empty texts
    have 0 tokens. Repeated rows are counted each. An empty table gives no
    rows; other columns are not read.
    """
    payload = Path(model).read_bytes()
    return text_map(docs, [doc_id], text, _Counts(payload), "n_tokens bigint")
