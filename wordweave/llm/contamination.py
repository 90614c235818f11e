"""Benchmark passages in documents, also with other numbers, names and units.

Both sides are turned into templates: a word is lower-cased and stripped of
punctuation; one with a digit or a number word becomes <number>, a unit of measure
after a number (or glued to it) <unit>, and a capitalised word inside a sentence
<name>. Names that follow each other are one placeholder, and so are number words.
At the start of a sentence a capital says little: a word that is a name elsewhere in
the text is one there too, a word that the text has in lower case or that usually
begins sentences is none, and for the rest the text has two readings, both of which
are looked for.

Windows of ``WINDOW`` template words are hashed; a document's windows that a
fixed-size bitmap of the benchmark's windows may hold are joined with the
benchmark's on the hash and on the template itself. Windows that lie on one diagonal
of a document and an item form an alignment. A name of the item
has to stand for one name of the document in all of it, a number or unit for one
value in every window that counts; two values of the item may become one. So a
question with exchanged parameters is found, and a text that merely has the same
shape is not. Where names do not agree, the windows count whose slots all have the
item's own values or that have none. Windows of an item with too few literal words
are looked for as plain words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.llm.common import Keep, by_row, portions
from wordweave.session import Scratch, cut

WINDOW = 8

# Literal words a window needs to match with other values, and windows an alignment needs (a short item:
# all it has). Items under ``WINDOW`` words are one window of their own length.
LITERALS, ALIGNED = 4, 3

# Size of the bitmap: 2 MB whatever the benchmark's size. A larger benchmark
# lets more windows through to the join, which decides.
MAP_BITS = 24

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"

# No other value begins with it; no other window with PLAIN, one of plain words.
AT, PLAIN = "@", "="

# Units of measure and money, singular and plural.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres mg g kg gram grams kilogram kilograms ton tons "
    "tonne tonnes ounce ounces pound pounds ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year "
    "years hz khz mhz ghz w kw watt watts v volt volts kb mb gb tb byte bytes bit bits "
    "dollar dollars euro euros cent cents percent degree degrees".split()
)

# Number words, and words that often begin a sentence and are no
# names (English, German, French, Spanish).
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "million billion dozen".split()
)
OPENERS = frozenset(
    "a an the this that these those it its he she they we you i his her their our your my if when while after "
    "before how what which who whom whose why where in on at for from with by of to and but or so as then there "
    "here each every all some any many much more most is are was were do does did can could will would should "
    "may might must no not yes please find calculate compute determine given let suppose consider solve show "
    "prove explain write assume during because although since until "
    "der die das ein eine er sie es wir ihr wenn wie was im auf von zu und oder "
    "le la les un une des il elle ils elles ce cette dans sur pour par si quand et ou "
    "el los las una unos unas él ella ellos ellas cuando como qué en por para con de y o".split()
)

EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”‘’«»…–—¿¡"
DIGIT = re.compile(r"\d")
GLUED = re.compile(r"(\d[\d.,]*)([A-Za-z]+)$")

SENTENCE_ENDS = (".", "!", "?", ":")

LITERAL, NUMBERED, SPELLED, NAMED, MEASURED = range(5)


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


# Of each kind but literals the placeholder and its code.
PLACEHOLDERS = {NUMBERED: NUMBER, SPELLED: NUMBER, NAMED: NAME, MEASURED: UNIT}
CODES = np.array([0] + [_code(PLACEHOLDERS[k]) for k in range(1, 5)], np.uint64)


# Marks of a form, as bits: ends a sentence; ends without a mark; capitalised; in
# lower case; a unit; often begins a sentence; has a second word. Below them the kind.
ENDS, OPENED, CAPITAL, LOWER, MEASURE, OPENER, DOUBLE, EMPTY = (1 << b for b in range(4, 12))
KIND = 15


class _Forms(dict):
    """Raw word -> number of its form, by its look alone; bounded. ``low`` has
    the plain word of a form, ``second`` the unit that was glued to it. Kinds are those
    inside a sentence."""

    KEPT = 250_000

    def __init__(self):
        super().__init__()
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.low: list[str] = []
        self.second: dict[int, str] = {}
        self.new_marks: list[int] = []
        self.new_codes: list[int] = []
        self.marks, self.codes = np.empty(0, np.int32), np.empty(0, np.uint64)

    def __missing__(self, raw: str) -> int:
        n = len(self.low)
        letters = raw.isalpha()
        if letters:
            word, marks = raw, OPENED
        else:
            word = raw.strip(EDGES)
            marks = OPENED if raw[-1].isalnum() else 0
            if raw.rstrip("\"')]}”’»")[-1:] in SENTENCE_ENDS:
                marks |= ENDS
        low = word.lower()
        if low == raw:
            low = raw  # one string for both
        if not letters and DIGIT.search(word):
            marks |= NUMBERED
            if (glued := GLUED.match(low)) and glued[2] in UNITS:
                low, self.second[n] = glued[1].rstrip(".,"), glued[2]
                marks |= DOUBLE
        elif low in NUMBER_WORDS:
            marks |= SPELLED
        elif low == word:
            marks |= LOWER if word else EMPTY
            if low in UNITS:
                marks |= MEASURE
        elif word[0].isupper() and (word not in ("I", "A") if len(word) == 1 else not word.isupper()):
            marks |= CAPITAL
        if low in OPENERS:
            marks |= OPENER
        self.low.append(low)
        self.new_marks.append(marks)
        self.new_codes.append(_code(low))
        self[raw] = n
        return n

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Marks and codes by the number of a form."""
        if self.new_marks:
            self.marks = np.concatenate([self.marks, np.array(self.new_marks, np.int32)])
            self.codes = np.concatenate([self.codes, np.array(self.new_codes, np.uint64)])
            self.new_marks, self.new_codes = [], []
        return self.marks, self.codes


class Template:
    """One reading of some texts: its template words, and the plain words that
    each of them begins with and consists of, text after text."""

    def __init__(self, kind, code, low, opened, begins, text):
        """Of each plain word the kind, the code of the word, the word, whether
        the next one may belong to it, whether it begins a sentence, and its text."""
        n = len(kind)
        number = (kind == NUMBERED) | (kind == SPELLED)
        joined = np.zeros(n, bool)
        if n:
            spelled = (kind == SPELLED)[1:] | (kind == SPELLED)[:-1]
            named = (kind[1:] == NAMED) & (kind[:-1] == NAMED) & ~begins[1:]
            together = named | (number[1:] & number[:-1] & spelled)
            joined[1:] = opened[:-1] & together & (text[1:] == text[:-1])
        self.starts = np.flatnonzero(~joined)
        self.low, self.plain, self.text_of_word = low, code, text
        self.kind = kind[self.starts]
        self.codes = np.where(self.kind == LITERAL, code[self.starts], CODES[self.kind])
        self.literals = np.r_[0, np.cumsum(self.kind == LITERAL)]
        self.ends = np.r_[self.starts[1:], n]
        self.text = text[self.starts]

    def window(self, at: int, size: int) -> tuple[str, list[str | None]]:
        """Template words and slot values; values of names begin with @."""
        words, values = [], []
        for place in range(at, at + size):
            own = " ".join(self.low[self.starts[place] : self.ends[place]])
            kind = int(self.kind[place])
            words.append(own if kind == LITERAL else PLACEHOLDERS[kind])
            values.append(None if kind == LITERAL else AT + own if kind == NAMED else own)
        return " ".join(words), values

    def plain_window(self, at: int, size: int) -> tuple[str, list[str | None]]:
        return PLAIN + " ".join(self.low[at : at + size]), [None] * size

    def inside(self, places: np.ndarray, size: int) -> np.ndarray:
        """Which windows of template words lie in one text."""
        last = places + size - 1
        fits = last < len(self.text)
        return fits & (self.text[np.minimum(last, len(self.text) - 1)] == self.text[places])

    def plain_inside(self, starts: np.ndarray, size: int) -> np.ndarray:
        last = starts + size - 1
        fits = last < len(self.plain)
        return fits & (self.text_of_word[np.minimum(last, len(self.plain) - 1)] == self.text_of_word[starts])


def readings(texts: list[str], forms: _Forms) -> tuple[Template, Template | None, np.ndarray]:
    """The reading of texts in which open words at the starts of sentences are
    literals, that in which they are names (None without any), and the plain words
    that are open."""
    if len(forms) > forms.KEPT:
        forms.begin()
    lines = [[line.split() for line in text.splitlines()] for text in texts]
    raw = np.fromiter(map(forms.__getitem__, chain.from_iterable(chain.from_iterable(lines))), np.int64)
    of_form, codes = forms.columns()
    marks = of_form[raw] if len(raw) else np.empty(0, np.int32)
    begins = np.r_[False, (marks[:-1] & ENDS) != 0] if len(raw) else np.empty(0, bool)
    firsts = np.cumsum([0, *map(len, chain.from_iterable(lines))])[:-1]
    begins[firsts[firsts < len(raw)]] = True
    owner = np.repeat(np.arange(len(texts)), [sum(map(len, t)) for t in lines])
    of = np.repeat(np.arange(len(raw)), np.where(marks & EMPTY, 0, np.where(marks & DOUBLE, 2, 1)))
    second = np.r_[False, of[1:] == of[:-1]] if len(of) else np.empty(0, bool)
    form, text, marks = raw[of], owner[of], marks[of]
    code = codes[form] if len(form) else np.empty(0, np.uint64)
    low = list(map(forms.low.__getitem__, form.tolist()))
    kind = marks & KIND
    for at in np.flatnonzero(second).tolist():
        low[at] = forms.second[int(form[at])]
        code[at], kind[at] = _code(low[at]), MEASURED
    opened, capital = (marks & OPENED) != 0, (marks & CAPITAL) != 0
    lower, unit, opener = (marks & LOWER) != 0, (marks & MEASURE) != 0, (marks & OPENER) != 0
    begins = begins[of] & ~second
    number = (kind == NUMBERED) | (kind == SPELLED)
    literal = kind == LITERAL
    after = np.r_[False, number[:-1] & (text[1:] == text[:-1])] if len(kind) else literal
    name = literal & capital & ~begins
    kind = np.where(name, NAMED, np.where(literal & lower & unit & after, MEASURED, kind))
    # A word and its text as one number.
    word = code ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.flatnonzero(literal & capital & begins & ~opener)
    again = np.isin(word[first], word[name])
    kind[first[again]] = NAMED
    first = first[~again]
    first = first[~np.isin(word[first], word[literal & lower])]
    made = Template(kind, code, low, opened, begins, text)
    if not len(first):
        return made, None, first
    kind = kind.copy()
    kind[first] = NAMED
    return made, Template(kind, code, low, opened, begins, text), first


# Odd multipliers of the window hash, one per place.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(WINDOW)], np.uint64)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash per window of ``size`` codes, as signed integers."""
    count = len(codes) - size + 1
    if count <= 0:
        return np.empty(0, np.int64)
    total = np.full(count, np.uint64(size))
    for place in range(size):
        mixed = codes[place : place + count] * MULTIPLIERS[place]
        total += mixed ^ (mixed >> np.uint64(29))
    return (total * MULTIPLIERS[0]).view(np.int64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)


WINDOWS = "pos int, hash bigint, words string, values array<string>, size int, plain boolean"


class _Windows:
    """Rows (id, text) -> windows (id, pos, hash, words, values, size, plain).

    ``pos`` counts the template words of the first reading up to the window's first
    word. Of the second reading there are only windows that hold an open word, as the
    others are the same. Documents: windows whose slot in the bitmap is set, of every
    size the benchmark has, and of ``plain`` sizes windows of plain words too, from
    where a template word begins. Items: all windows of the item's size, as plain
    words if they have too few literal ones.
    """

    def __init__(
        self, bitmap: np.ndarray | None = None, sizes: list[int] | None = None, plain: list[int] | None = None
    ):
        self.bitmap, self.sizes, self.plain = bitmap, sizes, plain

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _Forms()
        for batch in batches:
            for part, texts in portions(batch, 1):
                # Items differ in the size of their windows, so one at a time.
                groups = [texts] if self.bitmap is not None else [[t] for t in texts]
                begun = 0
                for some in groups:
                    rows = []
                    for row in self.windows(some, forms):
                        rows.append((begun + row[0], *row[1:]))
                        if len(rows) > 20_000:
                            yield self.frame(part, rows)
                            rows = []
                    yield self.frame(part, rows)
                    begun += len(some)

    def windows(self, texts: list[str], forms: _Forms):
        """(text, pos, hash, words, values, size, plain)"""
        first, second, open_words = readings(texts, forms)
        n = len(first.starts)
        # Of each text the place of its first template word.
        base = np.searchsorted(first.text, np.arange(len(texts)))
        yield from self.of(first, np.arange(n) - base[first.text], None)
        if second is not None:
            at = np.searchsorted(first.starts, second.starts)
            held = np.zeros(len(second.plain) + 1, np.int64)
            held[open_words + 1] = 1
            yield from self.of(second, at - base[second.text], np.cumsum(held))

    def of(self, reading: Template, pos: np.ndarray, held: np.ndarray | None):
        """Windows of a reading; with ``held``, the number of open words before
        each plain word, those with an open word."""

        def changed(places: np.ndarray, size: int) -> np.ndarray:
            if held is None or not len(places):
                return np.ones(len(places), bool)
            return held[reading.ends[places + size - 1]] > held[reading.starts[places]]

        def free(places: np.ndarray, size: int) -> np.ndarray:
            return reading.literals[places + size] - reading.literals[places] >= min(LITERALS, size)

        def row(place: int, value: int, words: tuple, size: int, plain: bool) -> tuple:
            return int(reading.text[place]), int(pos[place]), int(value), *words, size, plain

        n = len(reading.starts)
        if self.bitmap is None:
            size, plain_size = min(WINDOW, n), min(WINDOW, len(reading.plain))
            if not size:
                return
            hashes, bound = window_hashes(reading.codes, size), ~window_hashes(reading.plain, plain_size)
            places = np.arange(len(hashes))
            places = places[changed(places, size)]
            for place, is_free in zip(places.tolist(), free(places, size).tolist()):
                if is_free:
                    yield row(place, hashes[place], reading.window(place, size), size, False)
                elif held is None:
                    start = int(reading.starts[place])
                    yield row(place, bound[start], reading.plain_window(start, plain_size), plain_size, True)
            return
        for size in self.sizes:
            hashes = window_hashes(reading.codes, size)
            places = np.flatnonzero(self.known(hashes))
            places = places[reading.inside(places, size)]
            places = places[free(places, size) & changed(places, size)]
            for place in places.tolist():
                yield row(place, hashes[place], reading.window(place, size), size, False)
        for size in self.plain if held is None else ():
            places = np.flatnonzero(reading.starts + size <= len(reading.plain))
            places = places[reading.plain_inside(reading.starts[places], size)]
            hashes = ~window_hashes(reading.plain, size)[reading.starts[places]]
            for k in np.flatnonzero(self.known(hashes)).tolist():
                place = int(places[k])
                words = reading.plain_window(int(reading.starts[place]), size)
                yield row(place, hashes[k], words, size, True)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the bitmap may hold the hashes."""
        slot = _slot(hashes)
        return (self.bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1) != 0

    @staticmethod
    def frame(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, pos, hashes, words, values, size, plain = zip(*rows) if rows else ((),) * 7
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(pos, pa.int32()),
                pa.array(hashes, pa.int64()),
                pa.array(words, pa.string()),
                pa.array(values, pa.list_(pa.string())),
                pa.array(size, pa.int32()),
                pa.array(plain, pa.bool_()),
            ],
            ["id", "pos", "hash", "words", "values", "size", "plain"],
        )


def _windows(rows: DataFrame, row_id: str, text: str, windows: _Windows) -> DataFrame:
    kind = dict(rows.dtypes)[row_id]
    plain = rows.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    return plain.mapInArrow(windows, f"id {kind}, {WINDOWS}")


def _bitmap(items: DataFrame) -> np.ndarray:
    """The set slots of the benchmark's windows; at most 2**21 words of eight
    bits come to the driver, whatever the benchmark's size."""
    slot = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    place = slot.bitwiseAND(F.lit(7).cast("long")).cast("int")
    words = (
        items.groupBy(F.shiftright(slot, 3).alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), place)).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return bitmap


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    keep: Keep = cut,
) -> DataFrame:
    """(doc_id, item_id, windows, of, exact): which documents hold which items.

    ``windows`` of the item's ``of`` windows lie on the best alignment and are
    filled consistently; ``exact`` says that all slot values of the alignment
    are the item's own. NULL and empty texts hold nothing, items without
    a word are in nothing; long texts are read whole. Windows with too few literal
    words match as they are. Repeated rows give one row; rows without an id give none
    of their own but one with a NULL id. Of equally good alignments an exact
    one counts. Empty tables give no rows; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        items = scratch.keep(_windows(benchmark, item_id, text, _Windows()))
        kinds = sorted(tuple(r) for r in items.select("size", "plain").distinct().collect())  # 2 * WINDOW at most
        sizes, plain_sizes = ([size for size, is_plain in kinds if is_plain == wanted] for wanted in (False, True))
        seen = _windows(docs, doc_id, text, _Windows(_bitmap(items), sizes, plain_sizes))
        return keep(_aligned(seen, items))


def _aligned(seen: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, of, exact) from the windows of both sides."""
    mine = items.select(
        F.col("id").alias("item_id"),
        F.col("pos").alias("_pos"),
        "hash",
        "words",
        F.col("values").alias("theirs"),
    ).distinct()
    plain = F.col("plain")
    own = F.when(plain, F.col("theirs")).otherwise(F.col("ours"))
    pairs = seen.withColumnRenamed("values", "ours").join(mine, ["hash", "words"]).select(
        F.col("id").alias("doc_id"),
        "item_id",
        (F.col("pos") - F.col("_pos")).alias("diagonal"),
        "_pos",
        F.filter(F.arrays_zip("theirs", own.alias("ours")), lambda s: s["theirs"].isNotNull()).alias("slots"),
        "plain",
    )
    theirs, ours = (lambda s: s["theirs"]), (lambda s: s["ours"])
    # Slots of one window: an item's value stands for one value.
    one = F.size(F.array_distinct(F.transform("slots", theirs))) == F.size(F.array_distinct("slots"))
    place = ["doc_id", "item_id", "diagonal"]
    windows = pairs.select(
        *place,
        F.when(one, F.col("_pos")).alias("_one"),
        F.when(F.forall("slots", lambda s: theirs(s) == ours(s)), F.col("_pos")).alias("_same"),
        F.forall("slots", lambda s: theirs(s) == ours(s)).alias("_exact"),
        F.when(~plain, F.col("_pos")).alias("_free"),
        F.array_distinct(F.filter("slots", lambda s: theirs(s).startswith(AT))).alias("_names"),
    )
    # The windows of an alignment are at most those of its item.
    aligned = windows.groupBy(*place).agg(
        F.collect_set("_one").alias("_one"),
        F.collect_set("_same").alias("_same"),
        F.collect_set("_free").alias("_free"),
        F.bool_and("_exact").alias("exact"),
        F.array_distinct(F.flatten(F.collect_set("_names"))).alias("_names"),
    )
    named = F.size(F.array_distinct(F.transform("_names", theirs))) == F.size("_names")
    counted = aligned.withColumn("_counted", F.when(named, F.col("_one")).otherwise(F.col("_same"))).select(
        "doc_id",
        "item_id",
        "exact",
        F.size("_counted").alias("windows"),
        F.size(F.array_intersect("_counted", "_free")).alias("_free"),
    )
    lengths = items.groupBy(F.col("id").alias("item_id")).agg(
        F.count_distinct("pos").alias("of"), F.count_distinct(F.when(~plain, F.col("pos"))).alias("_of_free")
    )
    # Enough of all windows, or of those that match with other values.
    enough = (F.col("windows") >= F.least(F.col("of"), F.lit(ALIGNED))) | (
        (F.col("_of_free") > 0) & (F.col("_free") >= F.least(F.col("_of_free"), F.lit(ALIGNED)))
    )
    return (
        counted.where(F.col("windows") > 0)
        .join(lengths, "item_id")
        .where(enough)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("windows", "exact", "of")).alias("_best"))
        .select("doc_id", "item_id", "_best.windows", "_best.of", "_best.exact")
    )


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns; every row is judged
    by its own text, also one without an id."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))

    def drops(rows: DataFrame, key: str, keep: Keep) -> DataFrame:
        hit = contaminated(rows, items, key, keep=keep)
        return hit.select(F.col("doc_id").alias(key)).distinct()

    return by_row(docs, doc_id, text, drops)
