import random

import pytest
from frames_of import edges_df, graph, offers_df, tasks_df
from model import random_graphs, rows

from depweave.operators import edges as ops


def test_every_structural_verdict(spark):
    tasks = tasks_df(spark, [(1, 1, 1), (1, 2, 2), (2, 1, 3)])
    pairs = [(0, 1, 1), (1, 1, 1), (1, 2, 1), (99, 1, 1), (1, 1, 99), (2, 1, 1), (2, 1, 1)]
    offers = offers_df(spark, [(i, 1, late, g, early) for i, (late, g, early) in enumerate(pairs)])
    found = [r[1] for r in rows(ops.classify_edges(offers, tasks), "seq", "verdict")]
    assert found == ["invalid_handle", "self", "cross_graph", "missing", "missing", "ok", "repeat"]
    graphs = spark.createDataFrame([(1, True)], "graph_id long, finalised boolean")
    assert {r[0] for r in rows(ops.classify_edges(offers, tasks, graphs), "verdict")} == {"finalised"}


def test_null_handles_are_invalid(spark):
    offers = offers_df(spark, [(1, 1, None, 1, 1), (2, 1, 1, 1, None)])
    assert rows(ops.classify_edges(offers, tasks_df(spark, [(1, 1, 1)])), "verdict") == [("invalid_handle",)] * 2


def test_first_offer_of_an_edge_is_kept(spark):
    offered = edges_df(spark, [(1, 5, 2, 1), (1, 3, 2, 1), (1, 4, 3, 1), (2, 9, 2, 1)])
    assert rows(ops.dedupe_edges(offered)) == [(1, 3, 2, 1), (1, 4, 3, 1), (2, 9, 2, 1)]


def test_removed_edges_may_return(spark):
    _, edges = graph(spark, 3, [(2, 1), (3, 1)])
    doomed = spark.createDataFrame([(1, 2, 1), (1, 9, 9)], "graph_id long, dependent_id long, dependency_id long")
    left = ops.remove_edges(edges, doomed)
    assert rows(left, "dependent_id", "dependency_id") == [(3, 1)]
    again = left.unionByName(edges_df(spark, [(1, 7, 2, 1)]))
    assert rows(ops.dedupe_edges(again), "dependent_id", "dependency_id") == [(2, 1), (3, 1)]


def test_degrees_and_lists_cover_every_task(spark):
    tasks, edges = graph(spark, 4, [(2, 1), (3, 1), (4, 3), (4, 2)])
    assert rows(ops.degrees(tasks, edges)) == [(1, 1, 0, 2), (1, 2, 1, 1), (1, 3, 1, 1), (1, 4, 2, 0)]
    assert rows(ops.adjacency(tasks, edges), "task_id", "part", "dependencies", "dependents") == [
        (1, 0, [], [2, 3]),
        (2, 0, [1], [4]),
        (3, 0, [1], [4]),
        (4, 0, [3, 2], []),
    ]


@pytest.mark.parametrize("hot", [None, 3])
def test_long_lists_continue_in_parts(spark, limits, hot):
    rng = random.Random(1)
    tasks, edges = random_graphs(rng, 2, 12, 60, acyclic=False)
    tdf, edf = tasks_df(spark, tasks), edges_df(spark, edges)
    whole = {(g, t): (ins, outs) for g, t, ins, outs in rows(ops.adjacency(tdf, edf), "graph_id", "task_id", "dependencies", "dependents")}
    with limits(**({"hotRows": hot} if hot else {})):
        parts = rows(ops.adjacency(tdf, edf, part_size=2), "graph_id", "task_id", "part", "dependencies", "dependents")
    assert max(len(x) for r in parts for x in r[3:]) == 2
    joined = {}
    for g, t, _, ins, outs in parts:
        before = joined.get((g, t), ([], []))
        joined[g, t] = (before[0] + ins, before[1] + outs)
    assert joined == whole


def test_one_sided_links_are_found(spark):
    adj = spark.createDataFrame(
        [(1, 1, [], [2, 3]), (1, 2, [1], []), (1, 3, [], []), (1, 4, [1], [])],
        "graph_id long, task_id long, dependencies array<long>, dependents array<long>",
    )
    assert rows(ops.audit_links(adj)) == [(1, 3, 1, "dependency"), (1, 4, 1, "dependent")]
