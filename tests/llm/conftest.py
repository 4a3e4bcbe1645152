"""Tables that every operator has to stand: nothing in them, and all that may go wrong in them."""

import pytest

LONG = "Lorem ipsum dolor sit amet, consectetur. " * 3000
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "The quick brown fox jumps over the lazy dog. ALL RIGHTS RESERVED."), (5, "the quick brown fox jumps over the lazy dog. all rights reserved."),
    (6, "É la ÉCOLE naïve 日本語 text\x0bwith\x0codd\rspace"), (7, LONG), (8, LONG.upper()), (9, "a a a a a a a a a a a a"), (10, "you stupid idiot, you worthless scum " * 5),
    (11, "Licensed under the Apache License, Version 2.0."), (12, "x" * 5000), (12, "x" * 5000), (13, "General\nPublic   License cc-by"), (None, "no id here"), (None, None),
    (14, "# $ % & | < > * symbols | everywhere % of & the < text > # * $ %"), (15, "line\nline\nline\nother line\n\nline"), (9, "same id, other text"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, extra columns that clash with inner and result names."""
    rows = [(d, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None, 1.0, "x", i) for i, (d, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, norm string, kept long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
