import pytest

SMALL = "/root/testdata/sf0.01"

# Names that the operators use themselves.
CLASHING = "score predicted fp id hash run sha component_id lang_pred n_tokens _y _text values _id0 keep_id".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeated rows and ids, and
    columns whose names clash."""
    long = "alpha beta gamma delta " * 6000
    rows = [
        (1, "one two three four five six"),
        (2, "one  two three\nfour five six"),
        (3, None),
        (4, ""),
        (5, "   \n\t "),
        (6, long),
        (7, "x" * 100_000),
        (7, "x" * 100_000),
        (8, "one two three four five six"),
        (8, "another text under the same id"),
        (None, "one two three four five six"),
        (None, None),
        (9, "Æther ☃ 日本語 \u0000 end"),
        (10, "###"),
    ]
    frame = spark.createDataFrame(
        [(*r, "en", "s", 1, *["clash"] * len(CLASHING)) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, "
        + ", ".join(f"`{c}` string" for c in CLASHING),
    )
    return frame.repartition(3)


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, None, None), (6, 0, 1), (7, 0, 0), (7, 1, 0), (8, 1, None), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="session")
def small(spark):
    """The documents and labels of a small data folder."""
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    return {name: read(name) for name in ("documents", "labels", "benchmark", "pages")}
