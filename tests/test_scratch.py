from pyspark.sql import functions as F

from depweave.plans.scratch import Scratch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorted_ids_are_not_broadcast_for_small_files(spark):
    """Graph and task ids in order, whose encoded files are a small part of what they are in memory."""
    n = 1_000_000
    ids = spark.range(0, n, 1, 4).select((F.col("id") % 2000).alias("graph_id"), F.expr("id div 2000").alias("task_id"))
    scratch = Scratch(spark, "test")
    left, right = (scratch.put(ids, name)[0] for name in ("left", "right"))
    assert all(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= n * 16 for t in (left, right))
    joined = left.join(right.withColumn("found", F.lit(True)), ["graph_id", "task_id"], "left")
    assert "BroadcastHashJoin" not in plan_of(joined)
    assert joined.where("found").count() == n


def test_small_tables_are_still_broadcast(spark):
    scratch = Scratch(spark, "test")
    left, right = (scratch.put(spark.range(1000), name)[0] for name in ("left", "right"))
    assert "BroadcastHashJoin" in plan_of(left.join(right, "id"))
