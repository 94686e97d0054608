from pyspark.sql import functions as F

from textloom.operators import joins
from textloom.operators.ranking import global_rank


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id"), F.lit("x").alias("rn"))
    got = {r.id: r.rn for r in global_rank(df, [F.col("v").desc(), F.col("id")]).collect()}
    want = sorted(range(500), key=lambda i: (-(i * 7919 % 1000), i))
    assert got == {i: n + 1 for n, i in enumerate(want)}
    assert global_rank(df.where("false"), ["v"]).count() == 0


def test_global_rank_keeps_rows_in_many_tasks(spark):
    plan = global_rank(spark.range(100).withColumnRenamed("id", "v"), ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort [v" not in plan


def test_zip_stops_at_the_shorter(spark):
    a, b = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "i long, t string"), spark.createDataFrame([(9, "x"), (8, "y")], "j long, u string")
    assert sorted((r.t, r.u) for r in joins.zip_by_position(a, b, ["i"], ["j"]).collect()) == [("a", "y"), ("b", "x")]
