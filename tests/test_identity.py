import random

import pytest
from frames_of import tasks_df
from model import rows
from pyspark.sql import functions as F

from depweave.functions.handles import handle_key, in_range
from depweave.operators import identity
from depweave.plans.skew import previous_value, running_totals
from depweave.schemas import MAX_TASK_ID


def test_ids_count_up_per_graph(spark):
    df = spark.createDataFrame([(7, 30), (7, 10), (8, 20)], "g long, at long")
    assert rows(identity.assign_ids(df, "g", ["at"]), "g", "at", "task_id") == [(7, 10, 1), (7, 30, 2), (8, 20, 1)]


@pytest.mark.parametrize("start, ids", [(1, [1, 2]), (MAX_TASK_ID, [MAX_TASK_ID, None]), (0, [None, None])])
def test_ids_end_with_the_32_bit_range(spark, start, ids):
    df = spark.createDataFrame([(1, 1), (1, 2)], "g long, at long")
    found = identity.assign_ids(df, "g", ["at"], start).orderBy("at").collect()
    assert [r.task_id for r in found] == ids


def test_zero_and_null_are_invalid(spark):
    df = spark.createDataFrame([(0,), (None,), (5,)], "task_id long")
    assert rows(identity.valid_handles(df)) == [(5,)]


def test_handle_identity_needs_both_ids(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (MAX_TASK_ID, 1)], "g long, t long")
    keys = [r[0] for r in df.select(handle_key("g", "t")).collect()]
    assert keys[:3] == [(1 << 32) | 2, (2 << 32) | 1, (2 << 32) | 2]
    assert len(set(keys)) == 4
    checked = df.select(in_range("g").alias("ok")).union(spark.sql("SELECT 4294967296 BETWEEN 0 AND 4294967295"))
    assert rows(checked) == [(False,)] + [(True,)] * 4


def test_lookup_keeps_missing_handles(spark):
    tasks = spark.createDataFrame([(7, 1, 10, "First"), (7, 2, 11, "Second")], "graph_id long, task_id long, seq long, name string")
    handles = spark.createDataFrame([(7, 1), (7, 99), (8, 1), (7, 1)], "graph_id long, task_id long")
    assert rows(identity.lookup_tasks(handles, tasks), "graph_id", "task_id", "name", "found") == [
        (7, 1, "First", True),
        (7, 1, "First", True),
        (7, 99, None, False),
        (8, 1, None, False),
    ]


def test_tasks_are_listed_in_insertion_order(spark):
    tasks = tasks_df(spark, [(2, 1, 5), (1, 2, 9), (1, 1, 12), (1, 3, 3)])
    assert [tuple(r) for r in identity.list_tasks(tasks).collect()] == [(1, 3, 3), (1, 2, 9), (1, 1, 12), (2, 1, 5)]


def test_empty_graphs_count_zero(spark):
    graphs = spark.createDataFrame([(1,), (2,)], "graph_id long")
    assert rows(identity.task_counts(graphs, tasks_df(spark, [(1, 1, 1), (1, 2, 2)]))) == [(1, 2), (2, 0)]


@pytest.mark.parametrize("hot", [None, 2])
def test_append_continues_ids_and_refuses_frozen_graphs(spark, limits, hot):
    tasks = tasks_df(spark, [(1, 1, 1), (1, 4, 2), (2, 1, 3), (4, MAX_TASK_ID - 1, 4)])
    graphs = spark.createDataFrame([(1, False), (2, True), (3, None), (4, False)], "graph_id long, finalised boolean")
    new = spark.createDataFrame(
        [(1, 10, "a"), (1, 11, "b"), (2, 12, "c"), (3, 13, "d"), (4, 14, "e"), (4, 15, "f"), (1, 9, "g"), (7, 16, "h"), (None, 17, "i")],
        "graph_id long, seq long, name string",
    )
    with limits(**({"hotRows": hot} if hot else {})):
        found = rows(identity.append_tasks(tasks, graphs, new), "seq", "accepted", "graph_id", "task_id", "name")
    assert found == [
        (9, True, 1, 5, "g"),
        (10, True, 1, 6, "a"),
        (11, True, 1, 7, "b"),
        (12, False, 2, None, "c"),
        (13, True, 3, 1, "d"),
        (14, True, 4, MAX_TASK_ID, "e"),
        (15, False, 4, None, "f"),
        (16, False, 7, None, "h"),
        (17, False, None, None, "i"),
    ]


def test_sliced_totals_equal_plain_windows(spark, limits):
    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(5), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "k long, a long, b long, v long").repartition(5)
    plain = rows(running_totals(df, ["k"], ["a", "b"], rank=F.lit(1), total=F.col("v")))
    back = rows(previous_value(df, ["k"], ["a", "b"], "v", "before"))
    with limits(hotRows=30):
        assert rows(running_totals(df, ["k"], ["a", "b"], rank=F.lit(1), total=F.col("v"))) == plain
        assert rows(previous_value(df, ["k"], ["a", "b"], "v", "before")) == back
    with limits(hotRows=30, broadcastRows=1):
        assert rows(running_totals(df, ["k"], ["a", "b"], rank=F.lit(1), total=F.col("v"))) == plain
    expected = {}
    for k, a, b, v in sorted(data, key=lambda r: (r[0] or 0, r[1], r[2])):
        rank, total = expected.get(k, (0, 0))
        expected[k] = (rank + 1, total + v)
        assert (k, a, b, v, rank + 1, total + v) in plain


def test_handles_out_of_range_have_no_key(spark):
    df = spark.createDataFrame([(1, 2), (0, 4294967298), (-1, 2), (4294967295, 4294967295)], "graph_id long, task_id long")
    keys = [r[0] for r in df.select(handle_key("graph_id", "task_id")).collect()]
    assert keys == [4294967298, None, None, -1]
