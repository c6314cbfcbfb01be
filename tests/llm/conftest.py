from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents of (doc_id, text) rows; extra adds columns whose names the operators use themselves."""

    def make(rows, extra: bool = False):
        df = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOCS)
        if extra:
            for name in ("id", "fp", "node", "root", "bucket", "grams", "__gone", "__epoch", "__id", "__domain", "__n", "row", "tokens", "toxic", "host", "path", "x", "y", "a", "b"):
                df = df.selectExpr("*", f"'clash' AS `{name}`")
        return df

    return make


LONG = " ".join(f"wort{i % 977}x{i}" for i in range(60_000))
EDGE_ROWS = [
    (1, None), (2, ""), (3, ""), (4, "   \n\t"), (5, "one"), (6, "one"), (7, "One two"), (8, LONG), (9, LONG), (10, LONG + " end"),
    (11, "ünïcode tëxt hërë and emoji 😀😀 go"), (12, "ünïcode tëxt hërë and emoji 😀😀 go"), (None, "no id here"), (13, "a b c d e f"), (13, "a b c d e f"), (14, "a b c d e f g"),
]


@pytest.fixture
def edge_rows():
    return EDGE_ROWS
