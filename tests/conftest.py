import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wordweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    rows = [
        (1, "The cat sat.\nThe cat ran!"),
        (2, "A dog, a cat."),
        (3, ""),
        (4, "Élan 123 -- élan"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def lines(spark):
    rows = [(0, "the cat sat"), (1, "the cat ran"), (2, "NYT dog"), (3, "  "), (4, "Hi")]
    return spark.createDataFrame(
        [(1, n, t) for n, t in rows], "doc_id long, line_no int, text string"
    )


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def table():
    return rows
