from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [
        (0, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4, "src0"),
        (1, None, "src0"),
        (2, "", None),
        (3, " \n\t ", "src1"),
        (4, "one two", "src1"),
        (5, "one two", "src1"),
        (5, "one two", "src1"),
        (None, "some words of a document without id", None),
        (7, "word " * 30_000, "src0"),
        (8, "It's <|endoftext|> ΑΣ'RE x'll  \x1c 12½ é 漢字 don't　z", "src0"),
        (9, "x" * 3000, "src2"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = {c: F.lit("clash") for c in ("word", "n", "row", "id", "key", "tokens", "score", "n_words", "host", "component", "line")}
    return df.withColumns(extra).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
