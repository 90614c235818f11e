"""Benchmark passages: brute force over plain words, and changed parameters."""

import re

import pytest

from wordweave.llm import contamination, queries

ITEM = (
    "Maria has 12 apples and gives 5 apples to Peter before the train leaves for Berlin. "
    "The train is 300 km away and moves at 60 km per hour, so how long until Maria sees Peter again?"
)
CHANGED = (
    "Anna has 31 apples and gives 7 apples to Oscar before the train leaves for Madrid. "
    "The train is 450 km away and moves at 90 km per hour, so how long until Anna sees Oscar again?"
)
MIXED_UP = (
    "Anna has 31 apples and gives 7 apples to Oscar before the train leaves for Madrid. "
    "The train is 450 km away and moves at 90 km per hour, so how long until Oscar sees Clara again?"
)


def found(spark, docs, items=((1, ITEM),)):
    docs = spark.createDataFrame([(i, t, 0, "c", "c") for i, t in docs], "doc_id long, text string, id int, hash string, item_id string")
    items = spark.createDataFrame(list(items), "item_id long, text string")
    rows = contamination.contaminated(docs, items).collect()
    return {(r.doc_id, r.item_id): (r.windows, r.of, r.exact) for r in rows}


def test_exchanged_parameters(spark):
    filler = "some words of another text that goes on for a while without end "
    rows = found(
        spark,
        [
            (1, ITEM),
            (2, filler + CHANGED + " " + filler),
            (3, MIXED_UP),
            (4, filler * 3),
            (5, ITEM.upper().replace(".", " .")),
            (6, " ".join(ITEM.split()[:9])),
        ],
    )
    whole = rows[1, 1]
    assert whole[0] == whole[1] and whole[2]
    assert rows[2, 1][0] >= whole[1] - 1 and not rows[2, 1][2]
    assert (3, 1) not in rows  # Peter would be both Oscar and Clara
    assert (4, 1) not in rows and (6, 1) not in rows


def test_hashes_by_hand():
    import numpy as np

    codes = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = contamination.window_hashes(codes, 8)
    again = [int(contamination.window_hashes(codes[i : i + 8], 8)[0]) for i in range(32)]
    assert hashes.tolist() == again
    swapped = codes.copy()
    swapped[[0, 1]] = swapped[[1, 0]]
    assert contamination.window_hashes(swapped, 8)[0] != hashes[0]
    assert len(contamination.window_hashes(codes[:5], 8)) == 0


def plain_words(text):
    words = [re.sub(r"^\W+|\W+$", "", w).lower() for w in text.split()]
    return [w for w in words if w]


def test_whole_table(spark, small):
    """Every document that shares three windows in a row with an item, by a
    plain search, and no other."""
    items = {}
    for r in small["benchmark"].collect():
        words = plain_words(r.text)
        for i in range(len(words) - 9):
            items.setdefault(tuple(words[i : i + 10]), set()).add(r.item_id)
    theirs = set()
    for r in small["documents"].select("doc_id", "text").collect():
        words = plain_words(r.text)
        for i in range(len(words) - 9):
            theirs |= {(r.doc_id, k) for k in items.get(tuple(words[i : i + 10]), ())}
    rows = queries.op9_contamination(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.item_id) for r in rows} == theirs
    assert len(theirs) > 10


def test_short_items_and_repeated_rows(spark):
    rows = found(
        spark,
        [(1, "well then, what is the capital of France today"), (1, "What is the capital of France?"), (None, ITEM), (2, None), (3, "")],
        [(1, "What is the capital of France?"), (2, ""), (3, None), (4, ITEM), (4, ITEM), (5, "12 34 56")],
    )
    assert set(rows) == {(1, 1), (None, 4)}


def test_odd_rows(odd, no_rows, spark):
    items = spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")
    assert contamination.contaminated(odd, items).count() == 0
    assert contamination.decontaminated(odd, items).count() == odd.count()
    assert contamination.contaminated(no_rows, items).count() == 0
    assert contamination.contaminated(odd, items.limit(0)).count() == 0
    assert contamination.decontaminated(odd, items).columns == odd.columns


@pytest.mark.parametrize("copies", [1, 30])
def test_an_item_many_times_in_one_text(spark, copies):
    rows = found(spark, [(1, "\n".join([ITEM, "other words in between"] * copies))])
    assert rows[1, 1][0] == rows[1, 1][1]


PEARS = "A farmer packs 3 apples and 4 pears into every box that goes to the market, how many fruits are in it"
TWINS = "A farmer packs 2 apples and later on during the same long day 2 pears into every box that goes to the market"
ROAD = "walked along the road and did not say a word about it to anyone who came by"
LONG = f"On that day Peter {ROAD} and then the others {ROAD} before somebody told Peter of it"


@pytest.mark.parametrize(
    ("item", "text"),
    [
        (PEARS, PEARS.replace("3", "5").replace("4", "5")),
        (PEARS.replace("4", "3"), PEARS.replace("4", "8")),
        (TWINS, TWINS.replace("2 apples", "3 apples").replace("2 pears", "5 pears")),
        (LONG, LONG.replace("told Peter", "told Oscar")),
        (LONG, LONG.replace("day Peter", "day Oscar")),
    ],
)
def test_values_that_meet_or_part(spark, item, text):
    windows, of, exact = found(spark, [(1, text)], [(1, item)])[1, 1]
    assert contamination.ALIGNED <= windows <= of and not exact


def test_names_that_part_need_equal_windows(spark):
    item = "so Anna gave it to Peter and then Peter took it to Anna"
    assert not found(spark, [(1, "so Anna gave it to Oscar and then Clara took it to Anna")], [(1, item)])
    assert found(spark, [(1, "so Anna gave it to Oscar and then Oscar took it to Anna")], [(1, item)])


@pytest.mark.parametrize(
    "item",
    ["What is 17 times 23?", "Compute 12 + 15 - 3", "Peter Anna Oscar Clara", "12 34 56", "3 km 4 km 5 km 6 km 7 km 8 km 9 km"],
)
def test_items_of_few_literal_words(spark, item):
    other = re.sub("Anna", "Paul", re.sub(r"\d+", "77", item))
    rows = found(spark, [(1, item), (2, f"and so {item.lower()} is here"), (3, other), (4, "17 12 3 km")], [(1, item)])
    assert set(rows) == {(1, 1), (2, 1)}
    assert all(windows == of and exact for windows, of, exact in rows.values())


def test_dense_stretch_of_a_longer_item(spark):
    dense = "1 2 3 4 5 6 7 8 9 10 11 12 13"
    item = "The first numbers that a child learns to count with are " + dense
    assert found(spark, [(1, dense), (2, dense.replace("7", "70"))], [(1, item)]).keys() == {(1, 1)}


def test_plain_windows_ask_no_more_of_others(spark):
    item = "tell me now please whether 5 7 9 11 8 13"
    assert found(spark, [(1, item.replace("9", "6").replace("13", "14"))], [(1, item)])


SHORT = "Maria has 12 apples. Maria eats 5 apples. How many apples does she have left at the end of the day?"
CITIES = "The night train runs from Berlin to Madrid and then goes on to Paris before it turns round and comes back"
WORDS = "A baker sells three loaves in the morning and five loaves in the evening, so how many loaves are sold in all"
WEIGHT = "A sack that weighs 7 kg is put on a cart that holds 5 kg already, so how much does the cart hold now"


@pytest.mark.parametrize(
    ("item", "text"),
    [
        (SHORT, SHORT.replace("Maria", "Anna").replace("12", "9").replace(" 5", " 4")),
        (SHORT, "Some other words come first. " + SHORT.replace("Maria", "Anna")),
        (CITIES, CITIES.replace("Berlin", "New York").replace("Madrid", "Los Angeles").replace("Paris", "San Jose")),
        (CITIES, CITIES.replace("Berlin", "O'Neil").replace("Madrid", "McDonald").replace("Paris", "X")),
        (WORDS, WORDS.replace("three", "12").replace("five", "twenty one")),
        (WORDS, WORDS.replace("three", "2 hundred")),
        (WEIGHT, WEIGHT.replace("7 kg", "9kg").replace("5 kg", "4kg")),
        (WEIGHT, WEIGHT.replace("7 kg", "5kg").replace("holds 5 kg", "holds 7 kg")),
    ],
)
def test_names_number_words_and_units(spark, item, text):
    windows, of, exact = found(spark, [(1, text)], [(1, item)])[1, 1]
    assert windows >= of - 1 and not exact


def test_roles_mixed_up_are_another_text(spark):
    cities = CITIES + " to Berlin and Madrid"
    mixed = cities.replace("from Berlin", "from New York").replace("to Madrid", "to Los Angeles").replace("Paris", "Rome")
    assert not found(spark, [(1, mixed.replace("to Berlin and Madrid", "to Los Angeles and New York"))], [(1, cities)])
    item = "Maria has 12 apples. Peter has 5 apples. So Maria gives Peter 3 apples of hers."
    same = "Anna has 9 apples. Oscar has 7 apples. So Anna gives Oscar 2 apples of hers."
    assert found(spark, [(1, same)], [(1, item)])
    assert not found(spark, [(1, same.replace("Anna gives Oscar", "Oscar gives Anna"))], [(1, item)])


def test_two_readings():
    forms = contamination._Forms()

    def words(text):
        found = contamination.readings([text], forms)[:2]
        return [r.window(0, len(r.codes))[0] for r in found if r is not None]

    assert words("Maria runs. Maria sees Peter Pan Smith, Anna") == [
        "maria runs maria sees <name> <name>", "<name> runs <name> sees <name> <name>"
    ]
    assert words("The cat saw Tom. Tom ran. Cat ran") == ["the cat saw <name> <name> ran cat ran"]
    assert words("in 7kg and 7 kg, or twenty one dollars; 3 4 b2b kg") == [
        "in <number> <unit> and <number> <unit> or <number> <unit> <number> <number> <number> <unit>"
    ]
    assert words("2 million people and NASA said I") == ["<number> people and nasa said i"]
    assert words("") == [""] and words(" - !\n") == [""]
    forms.KEPT = 0
    assert words("so Anna ran") == ["so <name> ran"]
