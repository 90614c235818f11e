"""SentencePiece encoding and decoding for merge models with byte fallback.

The encoding of a text is the one sequence of pieces in which every adjacent
pair is compatible: merging the characters of the two again gives the same two.
It is found by backtracking over Aho-Corasick matches: at each position the
longest piece is tried, then the longest piece that starts it, and so on. A
position from which nothing goes on is marked in a bitfield and never entered
again, which bounds the work by the number of matches.

No piece has the space mark after another character, and none has a character
outside the vocabulary, so merges never cross such a place. Texts are cut there
into units, a unit once more between characters that no piece has side by side, and
the code of a short unit is remembered within the task, in a table of bounded
size.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from wordweave.llm.common import text_map

# The space mark and the piece types of the model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

# Bounds of the tables a task keeps, in entries, and of a remembered unit.
UNITS, PAIRS, UNIT_LENGTH = 250_000, 1_000_000, 48


class _Codes(dict):
    """Unit -> its ids as bytes, filled when a unit is first met. The entries
    of the generation before are asked first and taken over when used."""

    def __init__(self, model: Pieces):
        super().__init__()
        self.model, self.before = model, {}

    def __missing__(self, unit: str) -> bytes:
        code = self.before.get(unit)
        if code is None:
            parts = self.model.parts(unit)
            if len(parts) > 1:
                code = b"".join(map(self.__getitem__, parts))
            else:
                code = array("I", self.model.unit_ids(unit)).tobytes()
        if len(unit) <= UNIT_LENGTH:
            self[unit] = code
        return code

    def bound(self) -> None:
        if len(self) > UNITS:
            self.before = dict(self)
            self.clear()


class Pieces:
    """A model file, ready to encode and decode."""

    def __init__(self, payload: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(payload)
        form, trained = proto.normalizer_spec, proto.trainer_spec
        if (
            form.precompiled_charsmap
            or form.remove_extra_whitespaces
            or not form.add_dummy_prefix
            or not form.escape_whitespaces
            or trained.model_type != trained.BPE
            or not trained.byte_fallback
            or trained.treat_whitespace_as_suffix
        ):
            raise ValueError("only merge models with byte fallback and no normalisation are covered")
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        types = [p.type for p in proto.pieces]
        if set(types) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has pieces of a type that is not covered")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.text, types)) if t == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces that go on after a space")
        self.byte_ids = [0] * 256
        self.bytes = [b""] * len(types)
        for i, (piece, kind) in enumerate(zip(self.text, types)):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
            elif kind == NORMAL:
                self.bytes[i] = piece.replace(SPACE, " ").encode()
            elif kind == UNKNOWN:
                self.bytes[i] = (trained.unk_surface or " ⁇ ").encode()
        self.is_byte = [t == BYTE for t in types]
        self.is_control = [t == CONTROL for t in types]
        self.bos, self.eos = trained.bos_id, trained.eos_id
        self.known = {c for p in self.ids for c in p}
        self.adjacent = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.matches = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matches.add_word(piece, (len(piece), i))
        self.matches.make_automaton()
        # Line ends and tabs part units too unless the vocabulary has them.
        parting = "".join(c for c in "\n\t\r" if c not in self.known)
        self.units = re.compile(f"{SPACE}*[^{SPACE}{parting}]+|{SPACE}+|[{parting or SPACE}]")
        self.shorter: dict[int, int] = {}
        self.size = [len(t) for t in self.text]
        self.compatible: dict[int, bool] = {}
        self.codes = _Codes(self)

    def parts(self, unit: str) -> list[str]:
        """The unit cut between characters that no piece has side by side."""
        parts, begun = [], 0
        for at in range(1, len(unit)):
            if unit[at - 1 : at + 1] not in self.adjacent:
                parts.append(unit[begun:at])
                begun = at
        parts.append(unit[begun:])
        return parts

    def merged(self, text: str) -> list[str]:
        """Merge characters by score, the leftmost of equal scores first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters again gives the two;
        ``left`` may be -1 for a piece at the start."""
        pieces = [self.text[i] for i in (left, right) if i >= 0]
        return self.merged("".join(pieces)) == pieces

    def shorter_than(self, piece: int) -> int:
        """The longest piece that is a proper prefix, or -1."""
        found = self.shorter.get(piece)
        if found is None:
            text = self.text[piece]
            found = -1
            for size in range(len(text) - 1, 0, -1):
                if text[:size] in self.ids:
                    found = self.ids[text[:size]]
                    break
            self.shorter[piece] = found
        return found

    def unit_ids(self, unit: str) -> list[int]:
        """The ids of a text without inner spaces."""
        if self.known.issuperset(unit):
            return self._matched(unit)
        ids: list[int] = []
        run = ""
        for char in unit:
            if char in self.known:
                run += char
                continue
            if run:
                ids += self._matched(run)
                run = ""
            ids += self._single(char)
        return ids + (self._matched(run) if run else [])

    def _single(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def _matched(self, text: str) -> list[int]:
        """Backtracking over a text of characters that occur in pieces."""
        if len(text) == 1:
            return [self.ids[text]] if text in self.ids else self._single(text)
        longest = [-1] * (len(text) + 1)
        for end, (size, piece) in self.matches.iter(text):
            longest[end + 1 - size] = piece  # longer ones end later
        if -1 in longest[:-1]:
            return self._with_gaps(text, longest)
        failed = bytearray(len(text) // 8 + 1)
        sizes, compatible, total = self.size, self.compatible, len(text)
        taken: list[int] = []
        last, at, piece = -1, 0, longest[0]
        while at < total:
            while piece >= 0:
                end = at + sizes[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    pair = last << 20 | piece
                    fits = compatible.get(pair)
                    if fits is None:
                        if len(compatible) >= PAIRS:
                            compatible.clear()
                        fits = compatible[pair] = self.fits(last, piece)
                    if fits:
                        break
                piece = self.shorter_than(piece)
            if piece >= 0:
                taken.append(piece)
                last, at, piece = piece, end, longest[end]
            elif taken:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= sizes[piece]
                last = taken[-1] if taken else -1
                piece = self.shorter_than(piece)
            else:
                raise ValueError(f"no encoding of {text[:40]!r}")
        return taken

    def _with_gaps(self, text: str, longest: list[int]) -> list[int]:
        """Some character starts no piece: it is no piece itself, though it
        occurs inside longer ones. Plain merging covers this rare case."""
        ids: list[int] = []
        for part in self.merged(text):
            ids += [self.ids[part]] if part in self.ids else self._single(part)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, begin and end included, as little-endian
        unsigned 32-bit integers."""
        ends = np.array([self.bos, self.eos], dtype="<u4").tobytes()
        if not text:
            return ends
        self.codes.bound()
        units = self.units.findall(SPACE + text.replace(" ", SPACE))
        return b"".join([ends[:4], *map(self.codes.__getitem__, units), ends[4:]])

    def decode(self, code: bytes) -> str:
        """The text of packed ids."""
        ids = np.frombuffer(code, dtype="<u4").tolist()
        data = b"".join(map(self.bytes.__getitem__, ids))
        first = next((i for i in ids if not self.is_control[i]), None)
        if first is not None and self.text[first].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._lenient(ids)

    def _lenient(self, ids: list[int]) -> str:
        """Decoding of ids whose bytes are no valid text: each byte that does
        not belong to a whole character becomes U+FFFD."""
        out, run, begun = [], b"", False

        def flush(run: bytes) -> str:
            text = ""
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        text += run[:size].decode()
                    except UnicodeDecodeError:
                        continue
                    run = run[size:]
                    break
                else:
                    text, run = text + "�", run[1:]
            return text

        for i in ids:
            if self.is_byte[i]:
                run += self.bytes[i]
            elif not self.is_control[i]:
                out.append(flush(run))
                piece = self.bytes[i].decode()
                out.append(piece[1:] if not begun and self.text[i].startswith(SPACE) else piece)
                run = b""
            begun = begun or not self.is_control[i]
        return "".join(out) + flush(run)


@cache
def _loaded(payload: bytes) -> Pieces:
    return Pieces(payload)


class _Coder:
    """Encodes and decodes the texts of a batch. A task builds the tables of
    the model once per worker; only the file's bytes travel."""

    def __init__(self, payload: bytes):
        self.payload = payload

    def __call__(self, texts: list[str]) -> dict[str, object]:
        model = _loaded(self.payload)
        codes = [model.encode(t) for t in texts]
        return {
            "n_tokens": pa.array([len(c) // 4 for c in codes], pa.int64()),
            "token_ids": pa.array(codes, pa.binary()),
            "decoded": pa.array([model.decode(c) for c in codes], pa.string()),
        }


def encoded(
    docs: DataFrame, model: str, kept: list[str] | None = None, text: str = "text"
) -> DataFrame:
    """Adds (n_tokens, token_ids, decoded) to the columns ``kept``.

    ``model`` is the path of a model file on the driver (half a megabyte).
    ``token_ids`` holds all ids, begin and end included, as little-endian
    unsigned 32-bit integers; ``decoded`` is decoded from them. NULL and empty
    texts have the two ids begin and end and decode to ''. Whole texts of any
    length are encoded; repeated rows are encoded each; an empty table gives no
    rows; other columns are not read.
    """
    payload = Path(model).read_bytes()
    schema = "n_tokens bigint, token_ids binary, decoded string"
    return text_map(docs, kept or ["doc_id"], text, _Coder(payload), schema)

