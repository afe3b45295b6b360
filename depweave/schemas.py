"""Table schemas and the fixed values every operator shares."""

from pyspark.sql import types as T

# They must equal the modelled system's for results to agree.
INVALID_TASK_ID = 0
MAX_TASK_ID = 4294967295
CHECKSUM_MULTIPLIER = 1099511628211
FRAME_STEP_SECONDS = 1.0 / 60.0
STATUSES = ("Success", "InvalidGraph", "GraphNotFinalised", "TaskFailed", "Unknown")


def _struct(**fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


LONG, STRING, BOOL = T.LongType(), T.StringType(), T.BooleanType()
FLOATS = T.ArrayType(T.FloatType())

GRAPHS = _struct(graph_id=LONG, finalised=BOOL)
TASKS = _struct(graph_id=LONG, task_id=LONG, seq=LONG, name=STRING)
EDGES = _struct(graph_id=LONG, edge_seq=LONG, dependent_id=LONG, dependency_id=LONG)
CANDIDATES = _struct(
    seq=LONG,
    dependent_graph_id=LONG,
    dependent_id=LONG,
    dependency_graph_id=LONG,
    dependency_id=LONG,
)
OUTCOMES = _struct(graph_id=LONG, task_id=LONG, failed=BOOL, error=STRING, cost_us=LONG)
COMPLETIONS = _struct(graph_id=LONG, task_id=LONG, ts=T.TimestampNTZType(), failed=BOOL)
SUMMARY = _struct(
    graph_id=LONG,
    status=STRING,
    executed_task_count=LONG,
    error=STRING,
    execution_time_us=LONG,
)
FRAMES = _struct(frame_id=LONG, positions=FLOATS, velocities=FLOATS)
RESOURCES = _struct(frame_id=LONG, idx=LONG, size_bytes=LONG)
