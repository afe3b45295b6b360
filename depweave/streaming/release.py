"""Streams of task completions.

Completions may be delivered more than once. Repeats are removed first, with state spread
over (graph, task), so what follows may simply count.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from depweave.plans.limits import limit
from depweave.plans.scratch import Scratch
from depweave.plans.skew import keys_above, sized_broadcast

TASK = ["graph_id", "task_id"]
# Microseconds since 1970, the same in every session time zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def release_stream(completions, edges, indegree, delay=None):
    """Release every task once, when the last of its dependencies completes.

    ``completions`` is a stream (graph_id, task_id, ts, failed); failed tasks release
    nothing. ``edges`` are distinct, and ``indegree`` holds (graph_id, task_id,
    n_dependencies). ``released_us`` is the time of the last completion. Roots wait for
    nothing and are not part of the stream.

    Run it in update mode: a count reaches the number of dependencies in one batch only, and
    changes no more, so each task passes the last filter once. The state of a waiting task is
    one count and one time, and counts are combined before the shuffle.

    Without ``delay`` completions may come at any time, and the state of all completed and released tasks stays.
    With it (such as "1 hour") completions come at most that much later than the latest time seen, later ones are ignored, and
    a repeat has a time within ``delay`` of the first. Then state is freed: a completion is held until the
    watermark has passed its time by ``delay``, and a waiting task until its release. Completions without a time are ignored.
    Waiting tasks of a graph with neighbouring ids (``CELL`` of them at most) share a row of state.
    """
    needed = indegree.select(
        "graph_id", F.col("task_id").alias("dependent_id"), F.col("n_dependencies").alias("needed")
    )
    links = edges.select("graph_id", "dependent_id", F.col("dependency_id").alias("task_id"))
    links = links.join(needed, ["graph_id", "dependent_id"])
    done = completions.where("NOT failed").withColumn("us", F.expr(MICROS))
    if delay is None:
        done = done.dropDuplicates(TASK)
    else:
        done = done.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
        done = done.withWatermark("ts", delay).dropDuplicatesWithinWatermark(TASK)
    # Written once, so that no micro-batch derives the static side again.
    links = Scratch(edges.sparkSession, "links").put(links, "rows")[0]
    done, links = _spread_hubs(done, links)
    met = done.join(links, [*TASK, "_part"])
    if delay is not None:
        met = met.select("graph_id", "dependent_id", F.expr(f"dependent_id div {CELL}").alias("_cell"), "needed", "us")
        return met.groupBy("graph_id", "_cell").applyInPandasWithState(_release, RELEASED, WAITING, "update", "NoTimeout")
    return (
        met.groupBy("graph_id", "dependent_id", "needed")
        .agg(F.count(F.lit(1)).alias("met"), F.max("us").alias("released_us"))
        .where("met = needed")
        .select("graph_id", F.col("dependent_id").alias("task_id"), "released_us")
    )


# Tasks of a graph whose states share a row: a call per task costs far more than its count.
CELL = 1024
RELEASED = "graph_id long, task_id long, released_us long"
WAITING = "tasks array<long>, met array<long>, latest array<long>"


def _release(key, frames, state):
    """The waiting tasks of one cell: count and latest time of each, removed with its release."""
    new = pd.concat([frame[["dependent_id", "needed", "us"]] for frame in frames], ignore_index=True)
    found = new.groupby("dependent_id").agg(needed=("needed", "first"), met=("us", "size"), latest=("us", "max"))
    tasks, needed, met, latest = (c.to_numpy(dtype=np.int64, copy=True) for c in (found.index, found["needed"], found["met"], found["latest"]))
    if state.exists:
        held = [np.array(values, dtype=np.int64) for values in state.get]
        _, old, again = np.intersect1d(held[0], tasks, assume_unique=True, return_indices=True)
        met[again] += held[1][old]
        latest[again] = np.maximum(latest[again], held[2][old])
        kept = [np.delete(values, old) for values in held]
    else:
        kept = [np.empty(0, dtype=np.int64)] * 3
    due = met >= needed
    kept = [np.concatenate([before, now[~due]]).tolist() for before, now in zip(kept, (tasks, met, latest))]
    if kept[0]:
        state.update(tuple(kept))
    elif state.exists:
        state.remove()
    if due.any():
        yield pd.DataFrame({"graph_id": key[0], "task_id": tasks[due], "released_us": latest[due]})


def _spread_hubs(done, links):
    """Cut the links of a dependency that very many tasks wait for into parts.

    Its completion is repeated once per part, so that the join to its links spreads over as
    many tasks. All other dependencies have the single part 0.
    """
    most = limit(links.sparkSession, "listEntries")
    hubs = keys_above(links.select(*TASK), TASK, most)
    whole = F.lit(0)
    if hubs is None:
        return done.withColumn("_part", whole), links.withColumn("_part", whole)
    sizes = links.join(hubs, TASK, "left_semi").groupBy(*TASK).agg(F.expr(f"CAST(count(1) div {most} + 1 AS INT)").alias("_parts"))
    sizes = sized_broadcast(sizes)
    parts = F.coalesce("_parts", F.lit(1))
    links = links.join(sizes, TASK, "left").withColumn("_part", F.pmod(F.xxhash64("dependent_id"), parts).cast("int"))
    repeated = F.explode(F.sequence(whole, parts - 1))
    return done.join(sizes, TASK, "left").withColumn("_part", repeated).drop("_parts"), links.drop("_parts")


def run_progress_stream(completions, totals, delay="1 hour"):
    """Executed tasks and status per graph so far: ``Success`` once all tasks are through,
    ``TaskFailed`` from the first failure on, ``Unknown`` while the run goes on.

    A run stops at its first failure: only completions before it, by ``ts``, then task id, count, whatever
    order they are delivered in. Of several completions of a task the earliest counts, a failed one before a good one
    of the same time.

    ``totals`` holds (graph_id, task_count). Completions may come up to ``delay`` late. A graph's state
    holds those of the last ``delay``; older ones are folded into a count, as no failure can
    precede them any more, and nothing is held beyond the first failure.
    """
    timed = completions.select(*TASK, "ts", "failed").where("graph_id IS NOT NULL AND task_id IS NOT NULL AND ts IS NOT NULL")
    # Event time has to be an instant; the session's time zone moves all of them alike.
    timed = timed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = timed.withColumn("us", F.unix_micros("ts"))
    counted = timed.groupBy("graph_id").applyInPandasWithState(_progress, PROGRESS, HELD, "update", "EventTimeTimeout")
    status = (
        F.when(F.col("failed"), "TaskFailed")
        .when(F.col("executed_task_count") == F.col("task_count"), "Success")
        .otherwise("Unknown")
    )
    return counted.join(totals, "graph_id").select("graph_id", "executed_task_count", status.alias("status"))


PROGRESS = "graph_id long, executed_task_count long, failed boolean"
# Folded completions, and those that a failure may still precede: task -> (time, 0 if failed, else 1).
HELD = "folded long, failure_us long, failure_task long, tasks array<long>, times array<long>, good array<int>"


def _progress(key, frames, state):
    """Rows of one graph and its state; pandas frames arrive one after the other."""
    folded, failure, held = 0, None, {}
    if state.exists:
        folded, failure_us, failure_task, tasks, times, good = state.get
        failure = None if failure_us is None else (failure_us, failure_task)
        held = dict(zip(tasks, zip(times, good)))
    mark = state.getCurrentWatermarkMs() * 1000
    for frame in frames:
        for task, at, bad in zip(frame["task_id"].tolist(), frame["us"].tolist(), frame["failed"].tolist()):
            # What is behind the watermark has been folded: it is a repeat, or too late.
            if at >= mark:
                held[task] = min(held.get(task, (at, 1)), (at, int(not bad)))
    failures = [(at, task) for task, (at, good) in held.items() if not good]
    failure = min([*failures, failure], key=lambda f: (f is None, f)) if failures or failure else None
    held = {task: found for task, found in held.items() if found[1] and (failure is None or (found[0], task) < failure)}
    count = folded + len(held)
    old = [task for task, (at, _) in held.items() if at < mark]
    folded += len(old)
    for task in old:
        del held[task]
    state.update((folded, *(failure or (None, None)), list(held), [at for at, _ in held.values()], [good for _, good in held.values()]))
    yield pd.DataFrame({"graph_id": [key[0]], "executed_task_count": [count], "failed": [failure is not None]})
