import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with those of results and internals."""

    def make(rows):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        for name in ("_text", "_id", "_row", "__lang", "keep_id", "score", "n_words", "fingerprint", "length", "_slot"):
            frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, ties, repeated rows, odd white space, and one very long text."""
    long = " ".join(f"word{i % 997} And more" for i in range(60_000))
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "One and the same text."),
        (5, "One and the same text."),
        (5, "One and the same text."),
        (6, "ein Text mit\u00a0Leerraum \u3000 und\tTabulator\r\n\u2003ende"),
        (7, "<|endoftext|> 's 're don't  DON'T \u00c9t\u00e9 e\u0301te \ud55c\uad6d\uc5b4 \U0001f600\U0001f600"),
        (8, long),
        (None, "a row without an id"),
        (9, "12345 678 !!! ###"),
    ]
