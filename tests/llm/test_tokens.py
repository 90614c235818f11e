"""SentencePiece coding against the library; token counts against the library
run as a unigram model."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from wordweave.llm import pieces, queries, tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
with open(PATH, "rb") as file:
    PAYLOAD = file.read()
MODEL = pieces.Pieces(PAYLOAD)


def unpacked(code):
    return [i for (i,) in struct.iter_unpack("<I", code)]


def agrees(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    code = MODEL.encode(text)
    assert unpacked(code) == ids, repr(text)
    assert MODEL.decode(code) == LIBRARY.decode(ids), repr(text)


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    agrees(text)


def test_texts_of_pieces():
    draw = random.Random(1)
    for _ in range(2000):
        agrees("".join(LIBRARY.id_to_piece(draw.randint(3, 31999)) for _ in range(draw.randint(1, 8))))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 33, 64, 1000])
def test_runs(n):
    for text in (" " * n, "a" * n, "x" + " " * n + "y", "\n" * n, "▁" * n, "=" * n, "é" * n, "\u0000" * n):
        agrees(text)


def test_any_ids_decode():
    draw = random.Random(2)
    for _ in range(1500):
        ids = [draw.randint(0, 31999) if draw.random() < 0.5 else draw.randint(3, 258) for _ in range(9)]
        assert MODEL.decode(struct.pack(f"<{len(ids)}I", *ids)) == LIBRARY.decode(ids), ids


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "UNITS", 5)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    model = pieces.Pieces(PAYLOAD)
    for text in ("The cat sat on the mat.", "unbelievable words, again; words", "The cat sat"):
        assert unpacked(model.encode(text)) == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_another_kind_of_model_is_refused():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(PAYLOAD)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    with pytest.raises(ValueError):
        pieces.Pieces(proto.SerializeToString())


def test_query_over_whole_texts(spark, small):
    ours = {r.doc_id: tuple(r)[1:] for r in queries.op4_pieces(spark, "/root/testdata/sf0.01").collect()}
    rows = small["documents"].select("doc_id", "text").collect()
    assert len(ours) == len(rows)
    for r in rows:
        ids = LIBRARY.encode(r.text, add_bos=True, add_eos=True)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        decoded = LIBRARY.decode(ids).encode()
        assert ours[r.doc_id] == (
            len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()
        )


def test_odd_rows(odd, no_rows):
    rows = pieces.encoded(odd, PATH).collect()
    assert len(rows) == odd.count()
    assert sorted((r.doc_id or -1, r.decoded) for r in rows) == sorted(
        (r.doc_id or -1, r.text or "") for r in odd.select("doc_id", "text").collect()
    )
    assert {(r.n_tokens, r.token_ids) for r in rows if r.doc_id in (3, 4)} == {(2, struct.pack("<2I", 1, 2))}
    assert pieces.encoded(no_rows, PATH).count() == 0


@pytest.fixture(scope="module")
def unigram():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(PAYLOAD)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    scores = tokencount.zipf_scores(proto)
    for piece in proto.pieces:
        if piece.type == tokencount.NORMAL:
            piece.score = scores[piece.piece]
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def best_by_hand(text, trie):
    """(score, tokens) of the best segmentation, over the whole text."""
    marked = tokencount.SPACE + text.replace(" ", tokencount.SPACE)
    best = [(0.0, 0)] + [None] * len(marked)
    for end in range(1, len(marked) + 1):
        for begin in range(max(0, end - trie.longest), end):
            score = trie.score.get(marked[begin:end])
            tokens = 1
            if score is None and end - begin == 1:
                score, tokens = trie.unknown, len(marked[begin].encode())
            if score is not None:
                total = best[begin][0] + score
                if best[end] is None or total > best[end][0]:
                    best[end] = (total, best[begin][1] + tokens)
    return best[-1]


def test_counts_by_hand_and_by_the_library(unigram):
    trie = tokencount.Trie(PAYLOAD)
    draw = random.Random(4)
    words = ["the", "cat", "reintroduction", "unbelievable", "Straße", "日本", "x1y2", ",", "☃☃", "a" * 90]
    for _ in range(300):
        text = draw.choice([" ", "  ", "\n", ""]).join(draw.choice(words) for _ in range(draw.randint(1, 6)))
        assert trie.count(text) == best_by_hand(text, trie)[1], repr(text)
    same = 0
    for _ in range(200):
        text = " ".join(draw.choice(words[:7]) for _ in range(draw.randint(1, 4)))
        same += trie.count(text) == len(unigram.encode(text))
    assert same == 200


def test_trie_begun_anew(monkeypatch):
    plain = tokencount.Trie(PAYLOAD)
    monkeypatch.setattr(tokencount, "NODES", 10)
    small = tokencount.Trie(PAYLOAD)
    for text in ("some words here", "other words there", "some words here again"):
        assert small.count(text) == plain.count(text)


def test_count_query(spark, small):
    trie = tokencount.Trie(PAYLOAD)
    ours = {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, "/root/testdata/sf0.01").collect()}
    rows = small["documents"].select("doc_id", "text").collect()
    assert len(ours) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text))[:150]:
        assert ours[r.doc_id] == best_by_hand(r.text, trie)[1]


def test_count_odd_rows(odd, no_rows):
    rows = tokencount.token_counts(odd, PATH).collect()
    assert len(rows) == odd.count()
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert tokencount.token_counts(no_rows, PATH).count() == 0
