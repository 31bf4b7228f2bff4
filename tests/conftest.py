from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from castlist.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(8, **{"spark.checkpoint.dir": str(folder)})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a Column function on one row of literal strings."""
    from pyspark.sql import functions as F

    def run(function, *values):
        names = [f"v{i}" for i in range(len(values))]
        row = spark.createDataFrame([values], ", ".join(f"{name} string" for name in names))
        return row.select(function(*(F.col(f"v{i}") for i in range(len(values))))).first()[0]

    return run


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(*texts: str):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    return make
