"""Rows that every operator must take: nulls, empty and long texts, ties,
repeated rows, an empty table, and columns with clashing names."""

import tempfile

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="inkprint-test-"))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, None, 0),
        (3, "One two three. Four\nfive six seven eight nine ten", "en", "a", 50),
        (3, "One two three. Four\nfive six seven eight nine ten", "en", "a", 50),
        (4, "One two three. Four\nfive six seven eight nine ten", "en", "b", 50),
        (None, "One two three. Four\nfive six seven eight nine ten", "en", "b", 50),
        (5, long, "de", "b", len(long)),
        (6, long + " tail", "de", None, len(long) + 5),
        (7, "x" * 300_000, "xx", "c", 300_000),
        (8, " \t\n ", "en", "c", 4),
        (9, "é😀 ü", "en", "c", 4),
        (3, "another text under the same number", "en", "a", 34),
        (None, None, None, None, None),
    ]
    made = spark.createDataFrame(rows, SCHEMA)
    extra = ("th", "n", "node", "size", "shard", "slot", "row_hash", "kept_id", "next", "block", "spans", "score", "q", "TEXT_", "h")
    return made.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
