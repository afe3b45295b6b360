"""Columns over task handles: the pair (graph id, task id), both unsigned 32-bit values."""

from pyspark.sql import functions as F

from depweave.schemas import INVALID_TASK_ID, MAX_TASK_ID


def is_valid_id(task_id):
    """True for a task id in range that is neither missing nor the reserved invalid id."""
    task_id = F.col(task_id) if isinstance(task_id, str) else task_id
    return task_id.isNotNull() & (task_id != INVALID_TASK_ID) & in_range(task_id)


def in_range(value):
    """True for a LONG that fits an unsigned 32-bit value."""
    value = F.col(value) if isinstance(value, str) else value
    return value.between(0, MAX_TASK_ID)


def handle_key(graph_id, task_id):
    """One LONG per handle: graph id in the high half, task id in the low half.

    NULL for a handle out of range. Unique for all others; graph ids from 2^31 upwards give negative
    keys.
    """
    task = F.col(task_id) if isinstance(task_id, str) else task_id
    return F.when(in_range(graph_id) & in_range(task), F.shiftleft(graph_id, 32).bitwiseOR(task))
