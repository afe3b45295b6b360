"""Task identity, lookup and growth of task tables."""

from pyspark.sql import functions as F

from depweave.functions.handles import is_valid_id
from depweave.plans.skew import attach, running_totals
from depweave.schemas import INVALID_TASK_ID, MAX_TASK_ID

HANDLE = ["graph_id", "task_id"]


def _nth_id(rank, start):
    """The id ``rank`` places after ``start``; NULL once the 32-bit range is used up."""
    found = rank + (start - 1)
    usable = (start != INVALID_TASK_ID) & (found <= MAX_TASK_ID)
    return F.when(usable, found)


def assign_ids(df, graph_col, order_by, start=1):
    """Number the rows of each graph from ``start`` along ``order_by`` (a total order).

    Rows past the largest 32-bit id get NULL, and so do all rows when ``start`` is 0.
    """
    ranked = running_totals(df, [graph_col], order_by, _rank=F.lit(1))
    return ranked.withColumn("task_id", _nth_id(F.col("_rank"), F.lit(start).cast("long"))).drop("_rank")


def valid_handles(df, col="task_id"):
    """Keep the rows whose id is neither missing nor the invalid id."""
    return df.where(is_valid_id(col))


def lookup_tasks(handles, tasks):
    """Find every handle; a handle without a task keeps NULL task columns and found=false."""
    marked = tasks.withColumn("found", F.lit(True))
    return handles.join(marked, HANDLE, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def list_tasks(tasks):
    """All tasks in insertion order, graph by graph."""
    return tasks.orderBy("graph_id", "seq")


def task_counts(graphs, tasks):
    """Number of tasks per graph, 0 for a graph without tasks."""
    counted = tasks.groupBy("graph_id").agg(F.count(F.lit(1)).alias("task_count"))
    return (
        graphs.select("graph_id")
        .join(counted, "graph_id", "left")
        .select("graph_id", F.coalesce("task_count", F.lit(0)).cast("long").alias("task_count"))
    )


def append_tasks(tasks, graphs, new, order_by=("seq",)):
    """Offer ``new`` rows to their graphs.

    Rows of finalised graphs are refused, and those of graphs that neither ``graphs`` nor ``tasks`` know;
    the others continue after the largest id present and are refused only when the id range is used up.
    Refused rows have no task id.
    """
    highest = tasks.groupBy("graph_id").agg(F.max("task_id").alias("_highest"))
    listed = graphs.groupBy("graph_id").agg(F.coalesce(F.max("finalised"), F.lit(False)).alias("_frozen"))
    known = listed.join(highest, "graph_id", "full_outer").withColumn("_known", F.lit(True))
    is_open = F.coalesce(F.col("_known") & ~F.coalesce("_frozen", F.lit(False)), F.lit(False))
    offered = attach(new, known, ["graph_id"]).withColumn("_open", is_open.cast("long"))
    ranked = running_totals(offered, ["graph_id"], list(order_by), _rank=F.col("_open"))
    first_free = F.coalesce("_highest", F.lit(0)) + 1
    task_id = F.when(F.col("_open") == 1, _nth_id(F.col("_rank"), first_free))
    return ranked.withColumn("task_id", task_id).select(
        F.col("task_id").isNotNull().alias("accepted"),
        "graph_id",
        "task_id",
        *[c for c in new.columns if c not in HANDLE],
    )
