import re
from collections import Counter

import duckdb
import pytest

from wordweave.llm import collocation, queries, sql

SCHEMA = "doc_id long, lang string, text string, prefix string, stripe string, total string"


def brute(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        n = 0
        for _, other, text in rows:
            if (other or "und") != lang:
                continue
            lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                for size in (1, 2, 3):
                    f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rated = []
        for p, a in candidates.items():
            longer = [c for q, c in candidates.items() if len(p) == 2 and len(q) == 3 and p in (q[:2], q[1:])]
            if any(100 * c >= 50 * a for c in longer):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def found(table, *bounds):
    got = collocation.phrases(table, "lang", "text", *bounds)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def texts():
    line = "New York is big. the New York Times; A b a b a b a b, San  Francisco\tbay area!"
    rows = [(i, "en", f"{line} filler{i % 7} word {i % 3}") for i in range(25)]
    rows += [(100 + i, None, "x y z x y z x y") for i in range(6)]
    rows += [(200 + i, "und", "x y\nz") for i in range(6)]
    rows += [(300, "en", None), (301, "en", ""), (302, "fr", " \t "), (303, None, None), (None, "en", line)]
    rows += [(304, "de", "groß \u0000 ☃ É \x1c é " * 30), (304, "de", "groß \u0000 ☃ É \x1c é " * 30)]
    return rows


@pytest.mark.parametrize("least, top", [(10, 2000), (2, 5), (1, 2000)])
def test_equals_plain_counting(spark, texts, least, top):
    assert found(frame(spark, texts), least, top) == brute(texts, least, top)


def test_bounds_change_nothing(spark, texts, monkeypatch):
    """Counters that overflow, long stripes in rows, prefixes over shards and
    salted ranks."""
    expected = brute(texts, 2, 20)
    for name, value in (("WORDS", 5), ("ENTRIES", 20), ("SLICE", 9), ("ROW", 2), ("SHARD", 3), ("SPLIT", 1000), ("RANKED", 4)):
        monkeypatch.setattr(collocation, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(frame(spark, texts), 2, 20) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_full_bitmap_changes_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(collocation, "BITS_LEAST", 64)
    monkeypatch.setattr(collocation, "BITS_MOST", 64)
    assert found(frame(spark, texts), 3, 2000) == brute(texts, 3, 2000)


def test_long_text_and_no_rows(spark):
    rows = [(1, "en", "alpha beta gamma delta " * 20_000), (2, "en", "x" * 100_000)]
    assert found(frame(spark, rows)) == brute(rows, 10, 2000)
    assert found(frame(spark, rows).limit(0)) == []
    assert found(frame(spark, [(1, "en", None), (2, None, "")])) == []


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.createDataFrame([(big, big + 1, big)], "a long, l long, r long")
    assert row.select(collocation._score("a", "l", "r")).first()[0] == 1000000 * big * big // ((big + 1) * big)


def test_words_of():
    assert collocation.words_of("A,b\tÉ\x1fc".encode()) == [b"a", b"\xff", b"b", "É\x1fc".encode(), b"\xff"]


def test_sql_agrees(spark, texts, tmp_path):
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = sorted(tuple(r) for r in queries.op13_phrases(spark, str(tmp_path)).collect())
    assert ours == sorted(db.execute(sql.phrases()).fetchall())
