"""What a fail-fast run of a graph did, told from its order and the outcome of its tasks."""

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from depweave.functions.report import report_line
from depweave.plans.limits import limit
from depweave.plans.scratch import Scratch
from depweave.plans.skew import attach, key_join, keys_above, running_totals, sized_broadcast


def ready_tasks(tasks, edges, completed):
    """Unmet dependencies of every pending task, and whether it can start now."""
    key = ["graph_id", "task_id"]
    completed = completed.select(*key).distinct()
    done = completed.withColumnRenamed("task_id", "dependency_id")
    unmet = (
        edges.join(done, ["graph_id", "dependency_id"], "left_anti")
        .groupBy("graph_id", F.col("dependent_id").alias("task_id"))
        .agg(F.count(F.lit(1)).alias("unmet"))
    )
    remaining = F.coalesce("unmet", F.lit(0)).cast("long")
    return (
        tasks.select(*key)
        .join(completed, key, "left_anti")
        .join(unmet, key, "left")
        .select(*key, remaining.alias("remaining"), (remaining == 0).alias("ready"))
    )


def run_outcome(order, outcomes):
    """What became of every task: the first failing task ends the run of its graph.

    Tasks before it in run order are ``executed``; it is ``failed``; all others, and tasks
    that are never released, are ``not_started``.
    """
    # Both sides are large, whatever their compressed files seem to say, and the result is read twice.
    joined = order.join(outcomes.hint("merge"), ["graph_id", "task_id"], "left")
    run = Scratch(order.sparkSession, "outcomes").put(joined, "run")[0]
    stops = run.where("failed").groupBy("graph_id").agg(F.min("position").alias("_stop"))
    position, stop = F.col("position"), F.col("_stop")
    outcome = (
        F.when(position.isNull(), "not_started")
        .when(stop.isNull() | (position < stop), "executed")
        .when(position == stop, "failed")
        .otherwise("not_started")
    )
    return attach(run, stops, ["graph_id"], sized_by=order).withColumn("outcome", outcome).drop("_stop")


def run_summary(run, validity):
    """One row per graph of ``validity``: status, executed tasks, error and elapsed time.

    The failing task is not counted as executed, but its cost is part of the elapsed time.
    """
    executed, failed = F.col("outcome") == "executed", F.col("outcome") == "failed"
    per_graph = run.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(executed).alias("_executed"),
        F.count_if(failed).alias("_failed"),
        F.max(F.when(failed, F.col("error"))).alias("_error"),
        F.sum(F.when(executed | failed, F.col("cost_us"))).alias("_elapsed"),
    )
    frozen = F.coalesce("finalised", F.lit(False))
    status = (
        F.when(~frozen, "GraphNotFinalised")
        .when(F.col("_failed") > 0, "TaskFailed")
        .when(F.coalesce("_executed", F.lit(0)) == F.coalesce("_total", F.lit(0)), "Success")
        .otherwise("InvalidGraph")
    )

    def if_run(value):
        return F.when(frozen, value)

    return validity.join(per_graph, "graph_id", "left").select(
        "graph_id",
        status.alias("status"),
        F.coalesce(if_run(F.col("_executed")), F.lit(0)).cast("long").alias("executed_task_count"),
        if_run(F.col("_error")).alias("error"),
        F.coalesce(if_run(F.col("_elapsed")), F.lit(0)).cast("long").alias("execution_time_us"),
    )


def run_timeline(run, cost_col="cost_us"):
    """Start and end offset of every executed task when tasks run one after the other."""
    executed = run.where("outcome = 'executed'")
    cost = F.coalesce(F.col(cost_col), F.lit(0))
    timed = running_totals(executed, ["graph_id"], ["position"], end_us=cost)
    return timed.withColumn("start_us", F.col("end_us") - cost)


def render_report(summary):
    """The one-line text of every summary row."""
    line = report_line(
        F.col("status"), F.col("executed_task_count"), F.col("execution_time_us"), F.col("error")
    )
    return summary.select("graph_id", line.alias("report"))


PART = "_part"


def guarded_apply(df, keys, fn, schema, merge=None):
    """Run ``fn`` on every group; a failing group becomes an error row and the rest go on.

    Returns (results, errors). ``fn`` gets one group as a pandas frame and returns a frame of
    ``schema``; with ``fn=None`` the rows are passed through and every group succeeds.

    Without ``merge`` a group reaches ``fn`` whole, in one task. With ``merge``, every group of
    two rows or more is cut into parts; ``fn`` runs on one part after the other as they arrive, so that a
    task holds one part of a group and the results of its other parts, and ``merge(frame of all part results)``
    gives the group's result. The rows of a group of more than ``hotRows`` rows are dealt by hash to parts in several
    tasks. The group fails if any part fails. ``errors`` has the keys, ``status`` and ``error``.

    A result that does not fit ``schema`` is a failure of its group like an exception. Frames are
    those of Arrow: timestamps in the session's time zone, structs and maps as dictionaries.
    """
    spark = df.sparkSession
    if fn is None:
        no_errors = df.select(*keys, F.lit("").alias("status"), F.lit("").alias("error")).where(F.lit(False))
        return df, no_errors
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields, marks = schema.fieldNames(), [f"_key_{i}" for i in range(len(keys))]
    marked = df.withColumns(dict(zip(marks, map(F.col, keys))))
    most = limit(spark, "hotRows")
    hot = None if merge is None else keys_above(marked.select(*marks), marks, most)
    hot = hot if hot is None else sized_broadcast(hot)
    scratch = Scratch(spark, "guarded")
    work = _whole(fn) if merge is None else _in_parts(fn, merge)
    cold = marked if hot is None else key_join(marked, hot, marks, "left_anti")
    ran = scratch.put(_guarded(cold, marks, work, schema), "ran")[0]
    done, failed = ran.where("NOT _failed"), ran.where("_failed").select(*marks, "_error")
    if hot is not None:
        large = key_join(marked, hot, marks, "left_semi")
        width = large.count() // most + 1
        # Equal rows are told apart by the task that read them.
        part = F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.lit(width)).cast("int")
        ran = scratch.put(_guarded(large.withColumn(PART, part), [*marks, PART], _in_parts(fn), schema), "parts")[0]
        stopped = ran.where("_failed").groupBy(*marks).agg(F.min_by("_error", PART).alias("_error"))
        parts = key_join(ran.where("NOT _failed"), stopped, marks, "left_anti").select(*marks, *fields)
        merged = scratch.put(_guarded(parts, marks, _whole(merge), schema), "merged")[0]
        done = done.unionByName(merged.where("NOT _failed"))
        failed = failed.unionByName(stopped).unionByName(merged.where("_failed").select(*marks, "_error"))
    named = [F.col(mark).alias(key) for mark, key in zip(marks, keys)]
    errors = failed.select(*named, F.lit("TaskFailed").alias("status"), F.col("_error").alias("error"))
    return done.select(*fields), errors


def _whole(fn):
    """``fn`` on a group as one frame."""
    return lambda frames: fn(pd.concat(list(frames), ignore_index=True))


def _in_parts(fn, merge=None):
    """``fn`` on the frames of a group one by one, and ``merge`` on all their results.

    With ``merge`` the first frame is halved, so that no group but one of a single row stays in one part.
    """

    def work(frames):
        made = []
        for frame in frames:
            half = len(frame) // 2 if merge and not made else 0
            made += [fn(part.reset_index(drop=True)) for part in (frame[:half], frame[half:]) if len(part)]
        found = pd.concat(made, ignore_index=True)
        return merge(found) if merge else found

    return work


def _guarded(df, by, work, schema):
    """Run ``work`` on the frames of every group, its rows beside the group's key; a failure leaves one flagged row."""
    verdict = [T.StructField("_failed", T.BooleanType(), True), T.StructField("_error", T.StringType(), True)]
    nullable = [T.StructField(field.name, field.dataType, True) for field in schema.fields]
    shape = T.StructType([*[df.schema[name] for name in by], *verdict, *nullable])
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    declared = to_arrow_schema(T.StructType(nullable))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        key = first.select(by).slice(0, 1)
        try:
            made = _columns(work(_frame(batch.drop_columns(by), zone) for batch in chain([first], batches)), declared, zone)
            rows = len(made[0]) if made else 0
            problem = None
        except Exception as raised:  # whatever user code raises belongs to its group alone
            made, rows, problem = [pa.nulls(1, field.type) for field in declared], 1, str(raised)
        heads = [column.take(pa.array(np.zeros(rows, dtype=np.int64))) for column in key.columns]
        said = [pa.array([problem is not None] * rows, pa.bool_()), pa.array([problem] * rows, pa.string())]
        yield pa.RecordBatch.from_arrays([*heads, *said, *made], names=shape.fieldNames())

    return df.groupBy(*by).applyInArrow(apply, shape)


def _frame(batch, zone):
    """A batch as a pandas frame, with timestamps as local times of ``zone``."""
    frame = batch.to_pandas(maps_as_pydicts="strict")
    for field in batch.schema:
        if pa.types.is_timestamp(field.type) and field.type.tz:
            frame[field.name] = frame[field.name].dt.tz_convert(zone).dt.tz_localize(None)
    return frame


def _columns(frame, declared, zone):
    """The columns of a result as Arrow arrays of the declared types."""
    frame = frame[declared.names]
    for field in declared:
        column = frame[field.name]
        if pa.types.is_timestamp(field.type) and field.type.tz and getattr(column.dtype, "kind", "") == "M" and column.dt.tz is None:
            frame = frame.assign(**{field.name: column.dt.tz_localize(zone, ambiguous=False, nonexistent="shift_forward")})
    return pa.RecordBatch.from_pandas(frame, declared, preserve_index=False).columns
