import re

import pytest
from pyspark.sql import functions as F

from wordweave.functions import text as tx

SAMPLES = [
    "",
    "   ",
    "\t\t",
    "one",
    " lead and trail ",
    "a\u0085b　c\x1cd e",
    "... --- !!!",
    "O'Neil's 3rd iPhone, “NYT” ß-x ǆ İstanbul ΣΑΣ ΟΔΟΣ.",
    "x" * 5000 + " tail",
]


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string").orderBy("i")


def test_words_equal_whitespace_tokens(sample):
    got = [r[0] for r in sample.select(tx.words(F.col("text"))).collect()]
    assert got == [s.split() for s in SAMPLES]


def test_terms_equal_the_definition(sample):
    def terms(text):
        kept = ("".join(c for c in w.lower() if c.isalpha()) for w in text.split())
        return [w for w in kept if w]

    got = [r[0] for r in sample.select(tx.terms(F.col("text"))).collect()]
    assert got == [terms(s) for s in SAMPLES]


@pytest.mark.parametrize(
    "text", ["", "a", "a\n", "a\r\nb\rc\n\nd", "\n", "\r\n", "a\n\n", "\n\na"]
)
def test_lines_follow_text_files(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(tx.lines(F.col("text"))).first()[0]
    want = re.split("\r\n|\r|\n", text)
    assert got == (want[:-1] if want[-1] == "" else want)


def test_sentence_capitalises_the_first_word_only(spark):
    words = ["NYT dog", "éCLAIR Bad", "iPhone", ""]
    frame = spark.createDataFrame(list(enumerate(words)), "i int, text string").orderBy("i")
    got = [r[0] for r in frame.select(tx.sentence(tx.words(F.col("text")))).collect()]
    want = [
        [w.split()[0].capitalize(), *w.split()[1:], ""] if w.split() else [] for w in words
    ]
    assert got == want


def test_characters_keep_newlines(spark):
    frame = spark.createDataFrame([("a\r\n👍b\rc",)], "text string")
    assert frame.select(tx.characters(F.col("text"))).first()[0] == list("a\n👍b\nc")


def test_every_character_parts_words_as_the_plain_class_does(spark):
    codes = [*range(1, 0xD800), *range(0xE000, 0x11000)]
    rows = [(i, f"a{chr(i)}b{chr(i) * 3}c{chr(i)}") for i in codes]
    frame = spark.createDataFrame(rows, "i int, text string")
    plain = F.filter(F.split("text", f"[{tx.WHITESPACE}]+"), lambda w: w != "")
    fast = F.filter(F.split("text", f"[{tx._FAST_WHITESPACE}]+"), lambda w: w != "")
    parted = frame.select(plain.alias("plain"), fast.alias("fast"), tx.words(F.col("text")).alias("words"))
    assert parted.where((F.col("plain") != F.col("fast")) | (F.col("plain") != F.col("words"))).isEmpty()
    assert parted.where(F.size("words") == 3).count() == 29
