"""Small DataFrames from literal rows."""

TASKS = "graph_id long, task_id long, seq long"
EDGES = "graph_id long, edge_seq long, dependent_id long, dependency_id long"
OFFERS = "seq long, dependent_graph_id long, dependent_id long, dependency_graph_id long, dependency_id long"


def tasks_df(spark, tasks):
    return spark.createDataFrame(tasks, TASKS)


def edges_df(spark, edges):
    return spark.createDataFrame(edges, EDGES)


def graph(spark, n_tasks, pairs):
    """Tasks 1..n of graph 1, and edges (dependent, dependency) in the given order."""
    tasks = [(1, t, t) for t in range(1, n_tasks + 1)]
    edges = [(1, i, late, early) for i, (late, early) in enumerate(pairs)]
    return tasks_df(spark, tasks), edges_df(spark, edges)


def offers_df(spark, offers):
    return spark.createDataFrame(offers, OFFERS)


def offers_in_graph_1(spark, pairs):
    return offers_df(spark, [(i, 1, late, 1, early) for i, (late, early) in enumerate(pairs)])
