"""Line dedup shuffles in proportion to its input: no join changes its kind with the size."""

from piitrace.llm import line_dedup


def test_small_sides_are_not_broadcast(spark):
    lines = spark.createDataFrame([], "row long, key long, hashes binary, words binary, alive binary")
    runs = spark.createDataFrame([], "row long, begin long, end long")
    plan = line_dedup._deleted(lines, runs)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
