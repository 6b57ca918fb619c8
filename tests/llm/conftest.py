import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows with columns whose names clash with those that operators use."""

    def make(rows, parts=2):
        full = [(i, t, "en", "src", len(t or ""), 7, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long, component_id string").repartition(parts)

    return make
