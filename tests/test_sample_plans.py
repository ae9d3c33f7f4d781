"""Samples are taken apart by expressions that are computed once."""

from pyspark.sql import functions as F

from cadenza.operators import samples as B


def size_of(spark, column):
    df = spark.createDataFrame([([1, 8, 14, 2, 3, 9, 49, 50, 626, 2, 12, 9, 49, 626, 627],)], "t array<int>").select(column.alias("p"))
    assert df.first()["p"] is not None
    return df._jdf.queryExecution().optimizedPlan().expressions().mkString().count("array_position"), df


def test_a_sample_is_looked_through_once(spark):
    n, df = size_of(spark, B.parsed_sample(F.col("t")))
    assert n <= 10
    p = df.first()["p"]
    assert (p["task"], p["condition"], p["past"], p["gold"]) == ("meta_past", [8, 14, 2], {9: [49, 50]}, [9, 49, 626])
