import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


EDGE = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one two", None, "b", 7),
    (5, "One TWO", "en", "b", 7),
    (6, "alpha beta gamma delta epsilon zeta", "en", "b", None),
    (6, "alpha beta gamma delta epsilon zeta", "en", "b", None),
    (7, "Alpha beta gamma delta epsilon zeta", "en", "c", 1),
    (8, "word " * 30000, "en", "c", 1),
    (9, " ".join(f"w{i}" for i in range(30000)), "en", "c", 1),
    (10, "Ünïcode œuvre ñandú straße 𝒳𝒴 日本 語", "fr", "c", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(*r, "x", 1, "y") for r in EDGE]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size string, n long, component string"
    )


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
