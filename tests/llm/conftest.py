from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, `at` int, k_id string, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names."""
    texts = [
        (1, "Released under the MIT License. The cat sat on the mat"),
        (1, "Released under the MIT License. The cat sat on the mat"),
        (2, None),
        (2, ""),
        (3, "  \n\t "),
        (None, "token = 'abcdefghijkl' cc-by CC BY 4.0"),
        (None, None),
        (4, "x" * 50_000),
        (5, "the cat " * 5_000),
        (6, "ÉCOLE Été ñandú 日本語 ▁▁ a  b\r\n\x00 ſK"),
        (7, "12345 !!! 67890"),
        (8, "AKIA" + "B" * 20 + " deadbeefdeadbeef0 password:=x token: secret: 'abcdefghijklmnop'"),
    ]
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", None, "w", 3, "k", 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real_docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")
