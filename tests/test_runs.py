import sys

import pandas as pd
import pytest
from frames_of import graph
from model import rows
from pyspark import cloudpickle

from depweave.operators import order, runs

OUTCOMES = "graph_id long, task_id long, failed boolean, error string, cost_us long"


def run_of(spark, n, pairs, failing=()):
    tasks, edges = graph(spark, n, pairs)
    outcomes = spark.createDataFrame(
        [(1, t, t in failing, "task failed" if t in failing else None, 10 * t) for t in range(1, n + 1)], OUTCOMES
    )
    return runs.run_outcome(order.fifo_order(tasks, edges), outcomes)


def summary_of(spark, run, finalised=True):
    return rows(runs.run_summary(run, spark.createDataFrame([(1, finalised)], "graph_id long, finalised boolean")))


@pytest.mark.parametrize("n", [1, 2])
def test_all_roots_run(spark, n):
    assert summary_of(spark, run_of(spark, n, [])) == [(1, "Success", n, None, 10 if n == 1 else 30)]


def test_failing_task_is_not_counted_but_timed(spark):
    assert summary_of(spark, run_of(spark, 1, [], failing=[1])) == [(1, "TaskFailed", 0, "task failed", 10)]


def test_failure_in_the_middle_stops_everything_after_it(spark):
    run = run_of(spark, 5, [(2, 1), (3, 1), (4, 2), (4, 3)], failing=[3])
    assert rows(run, "position", "task_id", "outcome") == [
        (1, 1, "executed"),
        (2, 5, "executed"),
        (3, 2, "executed"),
        (4, 3, "failed"),
        (5, 4, "not_started"),
    ]
    assert summary_of(spark, run) == [(1, "TaskFailed", 3, "task failed", 10 + 50 + 20 + 30)]
    assert rows(runs.run_timeline(run), "task_id", "start_us", "end_us") == [(1, 0, 10), (2, 60, 80), (5, 10, 60)]


def test_timeline_of_a_hot_graph(spark, limits):
    run = run_of(spark, 12, [])
    plain = rows(runs.run_timeline(run), "task_id", "start_us", "end_us")
    with limits(hotRows=3):
        assert rows(runs.run_timeline(run), "task_id", "start_us", "end_us") == plain


def test_graphs_that_cannot_run_or_finish(spark):
    cyclic = run_of(spark, 3, [(2, 3), (3, 2)])
    assert rows(cyclic, "task_id", "outcome") == [(1, "executed"), (2, "not_started"), (3, "not_started")]
    assert summary_of(spark, cyclic) == [(1, "InvalidGraph", 1, None, 10)]
    assert summary_of(spark, cyclic, finalised=False) == [(1, "GraphNotFinalised", 0, None, 0)]


def test_report_lines(spark):
    summary = spark.createDataFrame(
        [
            (1, "Success", 3, None, 12000),
            (2, "TaskFailed", 1, "task failed", 2000),
            (3, "TaskFailed", 0, None, 1),
            (4, None, None, None, None),
            (5, "Odd", 0, None, 0),
        ],
        "graph_id long, status string, executed_task_count long, error string, execution_time_us long",
    )
    assert [r[1] for r in rows(runs.render_report(summary))] == [
        "SchedulerResult{status=Success, executedTaskCount=3, executionTime=12000micro(s), exception=none}",
        "SchedulerResult{status=TaskFailed, executedTaskCount=1, executionTime=2000micro(s), exception=task failed}",
        "SchedulerResult{status=TaskFailed, executedTaskCount=0, executionTime=1micro(s), exception=unknown exception}",
        "SchedulerResult{status=Unknown, executedTaskCount=0, executionTime=0micro(s), exception=none}",
        "SchedulerResult{status=Unknown, executedTaskCount=0, executionTime=0micro(s), exception=none}",
    ]


def test_ready_tasks_count_unmet_dependencies(spark):
    tasks, edges = graph(spark, 4, [(2, 1), (3, 1), (4, 2), (4, 3)])
    none = tasks.where("false")
    assert rows(runs.ready_tasks(tasks, edges, none), "task_id", "remaining", "ready") == [
        (1, 0, True),
        (2, 1, False),
        (3, 1, False),
        (4, 2, False),
    ]
    done = tasks.where("task_id IN (1, 2)")
    assert rows(runs.ready_tasks(tasks, edges, done.union(done)), "task_id", "remaining", "ready") == [
        (3, 0, True),
        (4, 1, False),
    ]


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # test functions run on executors


def total(group):
    if (group["v"] < 0).any():
        raise RuntimeError("task execution failed")
    return pd.DataFrame({"k": [group["k"].iloc[0]], "total": [group["v"].sum()]})


def add_up(parts):
    return pd.DataFrame({"k": [parts["k"].iloc[0]], "total": [parts["total"].sum()]})


@pytest.mark.parametrize("hot", [None, 20])
def test_one_failing_group_does_not_stop_the_others(spark, limits, hot):
    data = [(1, i) for i in range(100)] + [(2, 5), (2, -1)] + [(3, 7)] + [(4, -1 if i == 60 else 1) for i in range(90)]
    df = spark.createDataFrame(data, "k long, v long")
    with limits(**({"hotRows": hot} if hot else {})):
        results, errors = runs.guarded_apply(df, ["k"], total, "k long, total long", merge=add_up)
    assert rows(results) == [(1, 4950), (3, 7)]
    assert rows(errors) == [(2, "TaskFailed", "task execution failed"), (4, "TaskFailed", "task execution failed")]


def test_no_function_is_success(spark):
    df = spark.createDataFrame([(1, 2)], "k long, v long")
    results, errors = runs.guarded_apply(df, ["k"], None, "k long, v long")
    assert rows(results) == [(1, 2)] and rows(errors) == []


def test_a_result_of_the_wrong_type_fails_its_group_alone(spark):
    def odd(group):
        k = int(group["k"].iloc[0])
        return pd.DataFrame({"k": [k], "total": ["many" if k == 2 else 5]})

    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "k long, v long")
    results, errors = runs.guarded_apply(df, ["k"], odd, "k long, total long")
    assert rows(results) == [(1, 5), (3, 5)]
    assert [r.k for r in errors.collect()] == [2]


def test_merge_is_used_at_every_size(spark, limits):
    """A merge that is wrong gives the same wrong rows under any limit above the group."""
    df = spark.createDataFrame([(1, v) for v in range(50)], "k long, v long")

    def total(group):
        return group.groupby("k", as_index=False)["v"].sum()

    calls = []
    for most in (1000, 100, 50):
        with limits(hotRows=most):
            results, errors = runs.guarded_apply(df, ["k"], total, "k long, v long", merge=lambda parts: parts.head(1).assign(v=len(parts)))
            calls.append((rows(results), rows(errors)))
    assert calls[0][0] == [(1, 2)] and calls[0] == calls[1] == calls[2]


def test_frames_keep_dates_times_and_keys_without_a_value(spark):

    def latest(group):
        return pd.DataFrame({"k": group["k"].head(1), "t": [group["t"].max()]})

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT CAST(NULL AS LONG) AS k, TIMESTAMP '2024-03-01 12:00:00' AS t, 1 AS v UNION ALL SELECT 1, TIMESTAMP '2024-07-01 12:00:00', 2 UNION ALL SELECT 1, NULL, 3")
        results, errors = runs.guarded_apply(df, ["k"], latest, "k long, t timestamp", merge=latest)
        assert rows(results.withColumn("t", results.t.cast("string")).fillna(0)) == [(0, "2024-03-01 12:00:00"), (1, "2024-07-01 12:00:00")]
        assert rows(errors) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_large_group_is_never_one_frame(spark):
    """Each call of the function sees at most a batch; rows after a failure are skipped, not read as another group's."""
    df = spark.range(0, 60_000, numPartitions=3).selectExpr("id % 2 AS k", "id AS v")

    def largest(group):
        if group["v"].max() > 59_000 and group["k"].iloc[0] == 0:
            raise RuntimeError("late")
        return pd.DataFrame({"k": group["k"].head(1), "rows": [len(group)]})

    def most(parts):
        return pd.DataFrame({"k": parts["k"].head(1), "rows": [parts["rows"].max()]})

    results, errors = runs.guarded_apply(df, ["k"], largest, "k long, rows long", merge=most)
    [(k, n)] = rows(results)
    assert k == 1 and n <= 10_000 and rows(errors) == [(0, "TaskFailed", "late")]


def test_small_groups_of_a_large_table_are_not_dealt_out(spark, limits):
    df = spark.range(0, 400).selectExpr("IF(id < 200, 0, id % 20 + 1) AS k", "id AS v")

    def total(group):
        return group.groupby("k", as_index=False)["v"].sum()

    with limits(hotRows=50):
        results, errors = runs.guarded_apply(df, ["k"], total, "k long, v long", merge=lambda parts: parts.head(1).assign(v=len(parts)))
        [(_, most), *small] = rows(results)
    assert most > 2 and small == [(k, 2) for k in range(1, 21)] and rows(errors) == []


def test_the_order_is_joined_once_and_never_broadcast(spark):
    order = spark.range(1, 9).selectExpr("id % 2 AS graph_id", "id AS task_id", "0L AS level", "id AS position")
    outcomes = order.selectExpr("graph_id", "task_id", "task_id = 5 AS failed", "'no' AS error", "1L AS cost_us")
    run = runs.run_outcome(order, outcomes)
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Inner" not in plan
    found = {r.task_id: r.outcome for r in run.collect()}
    assert found == {1: "executed", 3: "executed", 5: "failed", 7: "not_started", **dict.fromkeys((2, 4, 6, 8), "executed")}
