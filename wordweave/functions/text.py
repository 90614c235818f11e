"""Text normal forms as pure column expressions.

Two normal forms exist and must not be mixed: *terms* (lower case, letters
only) feed the term statistics and the sentiment lookup, *words* (whitespace
tokens, untouched) feed everything built on word order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters at which a text is cut into words (the Unicode
# whitespace characters and the four ASCII separators).
WHITESPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAK = "\r\n|\r|\n"

# The same characters as one class that costs a character below U+0100 a single look
# in a bit set; ranges of the plain class are tried one after the other.
_FAST_WHITESPACE = (
    r"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}[\x{1680}-\x{3000}&&"
    r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)

# The state reached after the last word of a sentence. A word is never empty,
# so the marker cannot clash with text.
END = ""


def words(text: Column) -> Column:
    """Whitespace tokens in text order."""
    return F.filter(F.split(text, f"[{_FAST_WHITESPACE}]+"), lambda w: w != "")


def has_word(text: Column) -> Column:
    return text.rlike(f"[^{WHITESPACE}]")


def terms(text: Column) -> Column:
    """Whitespace tokens, lower-cased, non-letters removed, empties dropped.

    Stripping runs once over the whole text: removing every character that is
    neither letter nor whitespace leaves the token borders where they were.
    """
    kept = F.regexp_replace(F.lower(text), rf"[^\p{{L}}{WHITESPACE}]+", "")
    return words(kept)


def lines(text: Column) -> Column:
    """Lines of a text. A closing line break does not open another line, and
    an empty text has no line."""
    body = (
        F.when(text.endswith("\r\n"), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(
            text.endswith("\n") | text.endswith("\r"),
            F.substring(text, F.lit(1), F.length(text) - 1),
        )
        .otherwise(text)
    )
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK)
    )


def characters(text: Column) -> Column:
    """Single characters, every kind of line break read as one newline."""
    return F.filter(F.split(F.regexp_replace(text, LINE_BREAK, "\n"), ""), lambda c: c != "")


def sentence(line_words: Column) -> Column:
    """Words of one line as a sentence: the first word capitalised, the end
    marker appended. A line without words stays an empty array."""
    return F.when(
        F.size(line_words) > 0,
        F.concat(
            F.array(F.initcap(line_words[0])),
            F.slice(line_words, F.lit(2), F.size(line_words)),
            F.array(F.lit(END)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def adjacent(items: Column) -> Column:
    """Array of (w1, w2) structs of neighbours; no shuffle, no window."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(items, F.lit(1), n).alias("w1"), F.slice(items, F.lit(2), n).alias("w2")
    )


def starts_upper(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def to_sentence(path: Column, done: Column) -> Column:
    """Words joined by blanks; a finished sentence gets a period."""
    return F.concat(F.array_join(path, " "), F.when(done, ".").otherwise(""))
