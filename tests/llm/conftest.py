import sys

import pytest


@pytest.fixture
def rows_of_text(spark):
    """A documents table from texts, with further columns whose names clash with those used inside."""

    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        data = [(i, t, "en", s, 0, "x", 1, 2) for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(
            data, "doc_id long, text string, lang string, source string, n_chars long, row string, size int, key int",
        )

    return make
