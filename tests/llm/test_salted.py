"""Joins of rows dealt to many tasks."""

from pyspark.sql import functions as F

from foliant.llm.common import SALTS, salted


def test_copies_for_salting_do_not_go_through_the_driver(spark):
    frame = spark.range(200).select((F.col("id") % 5).alias("k"), "id")
    few = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "k long, v string")
    out = salted(frame, ["k"], "id", few)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["k"], r["v"], r["id"]) for r in out.collect()} == {(i % 5, {1: "a", 3: "b"}[i % 5], i) for i in range(200) if i % 5 in (1, 3)}
    assert out.count() == 80 and SALTS > 1
