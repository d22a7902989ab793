import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, n_words string, hash string, label int, kept string"


@pytest.fixture(scope="session")
def frame(spark, tmp_path_factory):
    """A written table of (doc_id, text[, lang]) rows whose other columns clash with names that operators use."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, 7, "x", None, 1, "k") for r in rows]
        path = str(tmp_path_factory.mktemp("table") / "t")
        spark.createDataFrame(full, DOCS).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)

    return make




@pytest.fixture(scope="session")
def edge(frame):
    from rows import EDGE

    return frame(EDGE)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
