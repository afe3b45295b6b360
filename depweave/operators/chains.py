"""Levels of large graphs after chains have been contracted.

A task with a single dependency is exactly one level (or the link's weight) above it. Such tasks point to
their dependency; pointer jumping doubles the distance they cover per round, until each
points to its head, the nearest task below that is no such task. What is left is a graph of heads with
weighted links. Links that have become parallel are one, the heaviest, so heads may be chains again, and
the contraction is repeated while it pays. What a chain has within a range of ids is passed at once, in one task; a
chain that changes its range n times takes about log2(n) rounds, in which only pointers that still move are joined again.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators.blocks import levels_by_blocks
from depweave.plans import kernels
from depweave.plans.limits import limit
from depweave.plans.scratch import Scratch
from depweave.plans.skew import attach

KEY = ["graph_id", "task_id"]
# The contraction goes on while at least one task in so many has a single dependency.
WORTH = 8
NEAR = "graph_id long, task_id long, to long, distance long"
NEAR_ARROW = pa.schema([(name, pa.int64()) for name in (*KEY, "to", "distance")])


def levels_by_chains(tasks, edges):
    """As `levels_by_blocks`; tasks are distinct, edges may be parallel."""
    scratch = Scratch(tasks.sparkSession, "chains")
    link = ["graph_id", "dependent_id", "dependency_id"]
    edges = scratch.put(edges.groupBy(*link).agg(F.max("weight").alias("weight")), "edges")[0]
    tasks, seen = scratch.put(tasks.select(*KEY), "tasks")
    incoming = edges.groupBy("graph_id", F.col("dependent_id").alias("task_id"))
    incoming = incoming.agg(F.count(F.lit(1)).alias("n"), F.min("dependency_id").alias("to"), F.min("weight").alias("distance"))
    known = tasks.withColumnRenamed("task_id", "to")
    pointers = incoming.where("n = 1").drop("n").join(tasks, KEY, "left_semi").join(known, ["graph_id", "to"], "left_semi")
    pointers, found = scratch.put(pointers.select(*KEY, "to", "distance"), "pointers-0")
    if found["rows"] * WORTH < max(seen["rows"], 1):
        return levels_by_blocks(tasks, edges)
    pointers, circling = _jump(pointers, found["rows"], scratch)
    heads = tasks.join(pointers.select(*KEY), KEY, "left_anti")
    above = edges.join(heads.withColumnRenamed("task_id", "dependent_id"), ["graph_id", "dependent_id"], "left_semi")
    source = pointers.select("graph_id", F.col("task_id").alias("dependency_id"), "to", "distance")
    moved = attach(above, source, ["graph_id", "dependency_id"])
    if circling is not None:
        # What waits for a circle waits for ever: its link leads to nothing.
        lost = circling.select("graph_id", F.col("task_id").alias("dependency_id"), F.lit(True).alias("_lost"))
        moved = attach(moved, lost, ["graph_id", "dependency_id"])
    else:
        moved = moved.withColumn("_lost", F.lit(None).cast("boolean"))
    moved = moved.select(
        "graph_id",
        "dependent_id",
        F.when(F.col("_lost").isNull(), F.coalesce("to", "dependency_id")).alias("dependency_id"),
        (F.col("weight") + F.coalesce("distance", F.lit(0))).alias("weight"),
    )
    if circling is not None:
        heads = heads.join(circling, KEY, "left_anti")
    levelled = scratch.put(levels_by_chains(heads, moved), "heads")[0]
    of_heads = levelled.select("graph_id", F.col("task_id").alias("to"), "level")
    chained = attach(pointers, of_heads, ["graph_id", "to"]).select(*KEY, (F.col("level") + F.col("distance")).alias("level"))
    result = levelled.unionByName(chained)
    if circling is not None:
        result = result.unionByName(circling.withColumn("level", F.lit(None).cast("long")))
    return result


def _jump(pointers, n, scratch):
    """Pointers to heads, and the tasks that lead into a circle (None if there are none)."""
    spark = scratch.spark
    # Tasks in id order, as in blocks: what a chain has within a range of ids is passed in one task.
    size = max(limit(spark, "bucketRows"), min(limit(spark, "graphRows"), n // spark.sparkContext.defaultParallelism))
    moving = pointers
    if n > size:
        near = pointers.repartitionByRange(-(-n // size), *KEY).select(*KEY, "to", "distance").mapInArrow(_jump_near, NEAR)
        moving = scratch.put(near, "near")[0]
        scratch.drop("pointers-0")
    # A pointer that did not move has its head; only the others are joined again.
    settled, left, turn = [], n, 0
    while left and turn <= math.ceil(math.log2(n + 1)):
        everything = reduce(DataFrame.unionByName, [*settled, moving])
        ahead = everything.select("graph_id", F.col("task_id").alias("to"), F.col("to").alias("_to"), F.col("distance").alias("_distance"))
        jumped = moving.join(ahead, ["graph_id", "to"], "left").select(
            *KEY,
            F.coalesce("_to", "to").alias("to"),
            (F.col("distance") + F.coalesce("_distance", F.lit(0))).alias("distance"),
            F.col("_to").isNotNull().cast("int").alias("moved"),
        )
        turn += 1
        found, seen = scratch.put(jumped, f"pointers-{turn}", partition_by=["moved"], moving=F.count_if(F.col("moved") == 1))
        scratch.drop(f"pointers-{turn - 1}/moved=1" if turn > 1 else "near" if n > size else "pointers-0")
        settled.append(found.where("moved = 0").drop("moved"))
        left, moving = seen["moving"], found.where("moved = 1").drop("moved")
    pointers = reduce(DataFrame.unionByName, [*settled, moving] if left else settled or [moving])
    if not left:
        return pointers, None
    # After more jumps than a path can be long, only circles still have something ahead.
    circling = pointers.join(pointers.select("graph_id", F.col("task_id").alias("to")), ["graph_id", "to"], "left_semi").select(*KEY)
    circling = scratch.put(circling, "circling")[0]
    return pointers.join(circling, KEY, "left_anti"), circling


def _jump_near(batches):
    """Pointers moved as far as the pointers at hand lead; those that lead into a circle stay as they are."""
    table = pa.Table.from_batches(batches, NEAR_ARROW)
    graph, task, to, distance = (table.column(name).to_numpy() for name in NEAR_ARROW.names)
    ahead, far, length = kernels.finder(graph, task)(graph, to), to.copy(), distance.copy()
    for _ in range(len(task).bit_length() + 1):
        moving = np.flatnonzero(ahead >= 0)
        through = ahead[moving]
        length[moving], far[moving], ahead[moving] = length[moving] + length[through], far[through], ahead[through]
    circling = ahead >= 0
    far[circling], length[circling] = to[circling], distance[circling]
    yield from pa.table([graph, task, far, length], schema=NEAR_ARROW).to_batches(max_chunksize=100_000)
