"""What queries leave in the shared folder: their results and nothing else."""

from pathlib import Path
from urllib.parse import urlparse

import pytest

import corpus_pipeline
from wordweave.llm import queries
from wordweave.session import shared_folder

FOLDER = "/root/testdata/sf0.001"

# Queries that are a single pass leave nothing, the others their result.
PASSES = {"op1_quality", "op3_toxicity", "op4_pieces", "op5_licences", "op10_token_counts"}


def held(spark):
    folder = Path(urlparse(shared_folder(spark)).path)
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_leave_their_result(spark, name):
    before = held(spark)
    result = queries.QUERIES[name](spark, FOLDER)
    left = held(spark) - before
    assert not [p for p in left if p.startswith("scratch-")]
    assert len(left) == (0 if name in PASSES else 1), left
    assert result.count() > 0


def test_the_pipeline_leaves_its_last_stage(spark):
    before = held(spark)
    result = corpus_pipeline.run(spark, FOLDER)
    left = held(spark) - before
    assert not [p for p in left if p.startswith("scratch-")]
    (folder,) = (p for p in left if p.startswith("pipeline-"))
    # Beside it the numbers of the rows that three stages dropped.
    assert len(left) <= 4, left
    stages = {p.name for p in (Path(urlparse(shared_folder(spark)).path) / folder).iterdir()}
    assert stages == {str(len(corpus_pipeline.STAGES) - 1)}
    assert result.count() > 0
