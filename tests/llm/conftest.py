import os

import pytest

SF = "/root/testdata/sf0.001"

#: Every case in one table: nulls, empty and blank texts, a very long one, copies, repeated rows, and columns whose names clash with ours.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id string, score double, hub long, spans string, rate double, u double"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture()
def make(spark):
    def build(texts, langs=None, sources=None, ids=None):
        rows = []
        for i, t in enumerate(texts):
            rows.append((ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", None, None, "x", 0.0, 1, None, 1.0, 0.5))
        return spark.createDataFrame(rows, SCHEMA)

    return build
