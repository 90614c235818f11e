import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from wordweave.llm import alignment, queries

A, B = (public_tokenizers.path(m) for m in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def words():
    return alignment.Vocabularies(A, B)


@pytest.fixture(scope="module")
def aligner(words):
    return alignment.Aligner(words)


def brute(aligner, words, text):
    """(n_a, n_b, groups, pairs, ends) of one whole text by the bytes of the
    tokens alone."""
    nothing = 0, 0, "", [], []
    if not text:
        return nothing
    a = aligner.first.encode(" " + text, add_special_tokens=False).ids
    b = aligner.second.encode(text)
    data = (" " + text).encode()
    if b"".join(words.a[i] for i in a) != data or b"".join(words.b[i] for i in b) != data:
        return nothing
    ends = [np.cumsum([len(v[i]) for i in ids]).tolist() for ids, v in ((a, words.a), (b, words.b))]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, pairs, i, j = [], [], 0, 0
    for end in common:
        k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        pairs.append((a[k - 1], b[m - 1]))
        i, j = k, m
    return len(a), len(b), ";".join(groups), pairs, common


def checked(aligner, words, texts):
    pairs = [(p >> 32, p & 0xFFFFFFFF) for p in words.pairs.tolist()]
    for text, found in zip(texts, aligner.align([t or "" for t in texts])):
        n_a, n_b, links, groups, ends = alignment._rows(found, True)
        got = n_a, n_b, groups, [pairs[n] for n in links], list(ends)
        assert got == brute(aligner, words, text), text


def test_whole_table(small, aligner, words):
    texts = [r.text for r in small["documents"].select("text").limit(400).collect()]
    checked(aligner, words, texts)


def test_random_texts(aligner, words):
    rng = random.Random(3)
    alphabet = "ab  c'stT1é日😀▁\n\t  \u0085\x1c　\x00.,é한‍👩🏽﻿"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(2500)]
    texts += ["<s> a </s>", "x <|endoftext|> y", " ", "  ", "a ", " a", "<0x41> <unk>", "x" * 5000, "", None]
    texts += ["don't we'll I'M", "a  b   c", "é" * 300, "😀 😀", "▁", "a ▁b c"]
    checked(aligner, words, texts)


def test_small_tables_change_nothing(small, words, monkeypatch):
    for name, value in (("UNITS", 10), ("UNIT_LENGTH", 4), ("NEW", 50), ("TEXTS", 300)):
        monkeypatch.setattr(alignment, name, value)
    own = alignment.Aligner(words)
    texts = [r.text[:3000] for r in small["documents"].select("text").limit(40).collect()]
    for text in texts:
        checked(own, words, [text])


def test_linked_tokens_end_alike(words):
    pairs = words.pairs.tolist()
    assert len(pairs) < 1_000_000 and len(set(pairs)) == len(pairs)
    for a, b in ((p >> 32, p & 0xFFFFFFFF) for p in pairs[::97]):
        assert words.a[a].endswith(words.b[b]) or words.b[b].endswith(words.a[a])


def expected(aligner, words, rows):
    """The rows of the query, counted in plain Python."""
    found = [(i, brute(aligner, words, t)) for i, t in rows]
    counts = Counter(p for _, f in found for p in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, (n_a, n_b, groups, pairs, _) in found:
        best = sum(counts[p] == most[p[1]] for p in pairs)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(pairs), len(pairs), best, sum(counts[p] for p in pairs), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark, aligner, words, tmp_path, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_alignment(spark, str(tmp_path)).select(COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(aligner, words, rows)
    kinds = dict(got.dtypes)
    assert {kinds[c] for c in COLUMNS[:-1]} == {"bigint"} and kinds["groups_sha256"] == "string"


def test_query_on_a_small_folder(spark, aligner, words, small):
    rows = [(r.doc_id, r.text) for r in small["documents"].select("doc_id", "text").collect()]
    got = queries.op11_alignment(spark, "/root/testdata/sf0.01").select(COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(aligner, words, rows)


def test_real_outputs(spark, aligner, words, odd, no_rows):
    got = alignment.aligned(odd, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups", "ends", "n_groups"]
    want = sorted(repr(brute(aligner, words, r.text)[2:5:2]) for r in odd.collect())
    assert sorted(repr((r.groups, r.ends)) for r in got.collect()) == want
    assert alignment.aligned(no_rows, A, B).collect() == []
