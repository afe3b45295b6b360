from datetime import datetime, timedelta

import pytest
from frames_of import graph
from model import rows

from depweave.operators import edges as edge_ops
from depweave.schemas import COMPLETIONS
from depweave.sources.tables import stream_table
from depweave.streaming.drain import drain, latest
from depweave.streaming.release import release_stream, run_progress_stream

START = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of completions that delivers one list of rows per micro-batch."""

    def make(*batches):
        for i, batch in enumerate(batches):
            done = [(1, task, START + timedelta(seconds=at), failed) for task, at, failed in batch]
            spark.createDataFrame(done, COMPLETIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"c/b{i}"))
        reader = spark.readStream.schema(COMPLETIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        return reader.parquet(str(tmp_path / "c"))

    return make


def seconds(us):
    return us / 1e6 - (START - datetime(1970, 1, 1)).total_seconds()


@pytest.mark.parametrize("plan", [{}, {"listEntries": 1}])
def test_tasks_are_released_once_by_their_last_dependency(spark, stream, limits, plan):
    tasks, edges = graph(spark, 5, [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4)])
    indegree = edge_ops.degrees(tasks, edges).where("n_dependencies > 0")
    completions = stream([(1, 1, False), (1, 1, False)], [(2, 5, False)], [(2, 6, False), (9, 7, False)], [(3, 4, False), (4, 8, True)])
    with limits(**plan):
        released = rows(drain(release_stream(completions, edges, indegree), "update"), "task_id", "released_us")
    assert [(t, seconds(us)) for t, us in released] == [(2, 1), (3, 1), (4, 5)]


@pytest.mark.parametrize("plan", [{}, {"listEntries": 1}])
def test_state_is_freed_by_releases_and_the_watermark(spark, stream, limits, plan, tmp_path):
    tasks, edges = graph(spark, 6, [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 5)])
    indegree = edge_ops.degrees(tasks, edges).where("n_dependencies > 0")
    completions = stream(
        [(1, 1, False), (1, 1, False)],
        [(2, 5, False), (1, 1, False)],  # a repeat after its releases
        [(2, 6, False), (3, 4, False), (4, 8, True)],
        [(4, 9, False)],
        [(9, 100, False)],  # another graph's task, long after
        [(10, 200, False)],  # what is behind the watermark is ignored from the next batch on
        [(11, 300, False), (3, 4, False), (5, 7, False)],  # a repeat and a completion that come too late
    )
    with limits(**plan):
        released = release_stream(completions, edges, indegree, "20 seconds")
        found = []
        query = (
            released.writeStream.outputMode("update")
            .option("checkpointLocation", str(tmp_path / "progress"))
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, batch: found.extend(map(tuple, rows.collect())))
            .start()
        )
        query.awaitTermination()
    assert sorted((task, seconds(us)) for _, task, us in found) == [(2, 1), (3, 1), (4, 5), (5, 9)]
    held = [[op["numRowsTotal"] for op in p["stateOperators"]] for p in query.recentProgress]
    # Task 4 waits once; in the end no task waits, and only the latest completion may still be repeated.
    assert max(waiting for waiting, _ in held) == 1
    assert held[-1] == [0, 1]


def test_a_delay_does_not_change_what_is_released(spark, stream):
    tasks, edges = graph(spark, 5, [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4)])
    indegree = edge_ops.degrees(tasks, edges).where("n_dependencies > 0")
    completions = stream([(3, 4, False), (1, 1, False)], [(2, 5, False), (4, 3, True)], [(4, 2, False), (2, 6, False)])
    plain, freed = (rows(drain(release_stream(completions, edges, indegree, d), "update"), "task_id", "released_us") for d in (None, "1 hour"))
    assert plain == freed and len(plain) == 4


def test_neighbouring_waiting_tasks_share_a_row_of_state(spark, stream, tmp_path):
    tasks, edges = graph(spark, 1500, [(task, root) for task in range(3, 1501) for root in (1, 2)])
    indegree = edge_ops.degrees(tasks, edges).where("n_dependencies > 0")
    completions = stream([(1, 1, False)], [(2, 2, False)])
    found = []
    query = (
        release_stream(completions, edges, indegree, "20 seconds")
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .foreachBatch(lambda rows, batch: found.extend(map(tuple, rows.collect())))
        .start()
    )
    query.awaitTermination()
    assert sorted((task, seconds(us)) for _, task, us in found) == [(task, 2) for task in range(3, 1501)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) == 2 and held[-1] == 0


def test_progress_follows_the_run(spark, stream):
    totals = spark.createDataFrame([(1, 3)], "graph_id long, task_count long")
    completions = stream([(1, 1, False), (1, 1, False)], [(2, 2, False)], [(1, 3, False), (3, 4, False)])
    updates = drain(run_progress_stream(completions, totals), "update")
    seen = [r[1:] for r in rows(updates, "batch", "executed_task_count", "status")]
    assert seen == [(1, "Unknown"), (2, "Unknown"), (3, "Success")]
    assert rows(latest(updates, ["graph_id"])) == [(1, 3, "Success")]


def test_first_failure_decides(spark, stream):
    totals = spark.createDataFrame([(1, 2)], "graph_id long, task_count long")
    updates = drain(run_progress_stream(stream([(1, 1, False), (2, 1, True)]), totals), "update")
    assert rows(latest(updates, ["graph_id"])) == [(1, 1, "TaskFailed")]


def test_completions_after_the_first_failure_do_not_count(spark, stream):
    """Whatever the order of delivery: by time, then task id, with the earliest completion of a task."""
    totals = spark.createDataFrame([(1, 6)], "graph_id long, task_count long")
    completions = stream(
        [(5, 50, False), (4, 40, False), (1, 10, False)],
        [(3, 30, True), (6, 30, False), (2, 20, False)],
        [(2, 15, False), (7, 45, True), (2, 30, False)],
        [(8, 20, True), (2, 20, True)],
    )
    updates = drain(run_progress_stream(completions, totals), "update")
    assert [r[1:] for r in rows(updates, "batch", "executed_task_count", "status")] == [(3, "Unknown"), (2, "TaskFailed"), (2, "TaskFailed"), (2, "TaskFailed")]


def test_a_task_that_fails_and_succeeds_at_once_has_failed(spark, stream):
    totals = spark.createDataFrame([(1, 2)], "graph_id long, task_count long")
    updates = drain(run_progress_stream(stream([(1, 1, False), (1, 1, True), (2, 2, False)]), totals), "update")
    assert rows(latest(updates, ["graph_id"])) == [(1, 0, "TaskFailed")]


def test_old_completions_are_folded_and_repeats_behind_the_watermark_do_not_count(spark, stream):
    totals = spark.createDataFrame([(1, 5)], "graph_id long, task_count long")
    completions = stream([(1, 10, False), (2, 20, False)], [(3, 100, False)], [(1, 10, False), (4, 110, False)], [(2, 20, False), (5, 111, False)])
    updates = drain(run_progress_stream(completions, totals, "5 seconds"), "update")
    assert [r[1:] for r in rows(updates, "batch", "executed_task_count", "status")] == [(2, "Unknown"), (3, "Unknown"), (4, "Unknown"), (5, "Success")]


def test_tables_can_be_frozen_once_and_streamed(spark, tmp_path):
    from depweave.sources.tables import freeze_table, read_table

    done = spark.createDataFrame([(1, 2, START, False)], COMPLETIONS)
    assert rows(freeze_table(done, str(tmp_path), "completions")) == rows(done)
    assert rows(read_table(spark, str(tmp_path), "completions")) == rows(done)
    assert rows(drain(stream_table(spark, f"{tmp_path}/completions", "completions")).drop("batch")) == rows(done)
    with pytest.raises(Exception, match="exists"):
        freeze_table(done, str(tmp_path), "completions")
