import random

import pytest
from frames_of import edges_df, graph, tasks_df
from model import queue_run, random_graphs, rows

from depweave.operators import cycles, order, reach
from depweave.plans.scratch import Scratch

PLANS = {
    "packs": {},
    "rounds": {"graphRows": 1},
    "rounds, then one task": {"graphRows": 25},
    "rounds, sliced": {"graphRows": 1, "hotRows": 3, "broadcastRows": 2},
}


def positions(df):
    return [r[0] for r in sorted(rows(df, "task_id", "position"), key=lambda r: r[1])]


@pytest.mark.parametrize(
    "n, pairs, expected",
    [
        (1, [], [1]),
        (2, [], [1, 2]),
        (3, [(2, 1), (3, 2)], [1, 2, 3]),
        (4, [(2, 1), (3, 1), (4, 2), (4, 3)], [1, 2, 3, 4]),
        (5, [(2, 1), (3, 1), (4, 2), (4, 3)], [1, 5, 2, 3, 4]),
        (3, [(3, 1), (2, 1)], [1, 3, 2]),
    ],
)
def test_queue_order_of_small_graphs(spark, n, pairs, expected):
    assert positions(order.fifo_order(*graph(spark, n, pairs))) == expected


def mixed_graphs(seed):
    """Three acyclic and three cyclic graphs."""
    rng = random.Random(seed)
    tasks, edges = random_graphs(rng, 3, 14, 22, acyclic=True)
    more_tasks, more_edges = random_graphs(rng, 3, 14, 22, acyclic=False)
    tasks += [(g + 3, t, seq) for g, t, seq in more_tasks]
    edges += [(g + 3, i, late, early) for g, i, late, early in more_edges]
    return tasks, edges + [(1, 9999, 3, 77), (2, 9998, 88, 3)]  # ends that are not tasks


@pytest.mark.parametrize("plan", PLANS)
def test_random_graphs_run_like_a_queue(spark, limits, plan):
    tasks, edges = mixed_graphs(7)
    expected = queue_run(tasks, edges)
    with limits(**PLANS[plan]):
        found = rows(order.fifo_order(tasks_df(spark, tasks), edges_df(spark, edges)), "graph_id", "task_id", "level", "position")
    assert {(g, t): (level, at) for g, t, level, at in found} == expected


@pytest.mark.parametrize("plan, blocks", [(None, 100_000), ("rounds", 4), ("rounds", 1), ("chains", 4)])
def test_levels_alone(spark, limits, plan, blocks):
    tasks, edges = mixed_graphs(8)
    with limits(bucketRows=blocks):
        found = rows(order.levels(tasks_df(spark, tasks), edges_df(spark, edges), plan=plan), "graph_id", "task_id", "level")
    assert {(g, t): level for g, t, level in found} == {key: level for key, (level, _) in queue_run(tasks, edges).items()}


def test_edges_ascend_and_positions_are_dense(spark):
    tasks, edges = random_graphs(random.Random(3), 4, 40, 90, acyclic=True)
    found = rows(order.fifo_order(tasks_df(spark, tasks), edges_df(spark, edges)), "graph_id", "task_id", "level", "position")
    at = {(g, t): (level, p) for g, t, level, p in found}
    assert all(at[g, early] < at[g, late] and at[g, early][1] < at[g, late][1] for g, _, late, early in edges)
    for g in range(1, 5):
        assert sorted(p for (h, _), (_, p) in at.items() if h == g) == list(range(1, 41))


def test_hub_with_most_edges(spark, limits):
    n = 400
    tasks = [(1, t, t) for t in range(1, n + 1)]
    edges = [(1, (t * 37) % 1009, t, 1) for t in range(2, n + 1)]
    expected = queue_run(tasks, edges)
    for plan in ({}, {"graphRows": 10, "hotRows": 50}):
        with limits(**plan):
            found = rows(order.fifo_order(tasks_df(spark, tasks), edges_df(spark, edges)), "graph_id", "task_id", "level", "position")
        assert {(g, t): (level, p) for g, t, level, p in found} == expected


def test_roots_and_leaves(spark):
    tasks, edges = graph(spark, 4, [(2, 1), (3, 2)])
    assert rows(order.roots_and_leaves(tasks, edges), "task_id", "is_root", "is_leaf") == [
        (1, True, False),
        (2, False, False),
        (3, False, True),
        (4, True, True),
    ]


def test_reasons_not_to_freeze(spark):
    graphs = spark.createDataFrame([(g,) for g in range(1, 5)], "graph_id long")
    tasks = tasks_df(spark, [(g, t, t) for g in (2, 3, 4) for t in (1, 2, 3)])
    edges = edges_df(
        spark,
        [(2, 1, 2, 1), (2, 2, 3, 2), (3, 1, 1, 2), (3, 2, 2, 3), (3, 3, 3, 1), (4, 1, 2, 3), (4, 2, 3, 2)],
    )
    assert rows(order.validate_graphs(graphs, tasks, edges)) == [
        (1, False, "empty"),
        (2, True, "ok"),
        (3, False, "no_root"),
        (4, False, "cycle"),
    ]


def messy(spark):
    """Tasks listed twice, NULLs everywhere, equal and missing ``seq`` and ``edge_seq``, repeated edges."""
    rng = random.Random(11)
    tasks = [(g, t, rng.choice([None, 1, 2, 3])) for g in (1, 2, 3) for t in range(1, 15)]
    tasks += [tasks[0], (1, 3, 0), (1, 3, None), (None, 1, 1), (2, None, 1), (None, None, None)]
    edges = []
    for g in (1, 2, 3):
        for _ in range(24):
            a, b = rng.sample(range(1, 15), 2)
            if g < 3:
                a, b = max(a, b), min(a, b)
            edges.append((g, rng.choice([None, 5, 6]), a, b))
    edges += [edges[0], (1, 5, None, 2), (1, 5, 2, None), (None, 5, 2, 1), (2, 7, 3, 99)]
    return (
        spark.createDataFrame(tasks, "graph_id long, task_id long, seq long"),
        spark.createDataFrame(edges, "graph_id long, edge_seq long, dependent_id long, dependency_id long"),
    )


def test_plans_agree_on_messy_rows(spark, limits):
    tasks, edges = messy(spark)
    plans = [{}, {"graphRows": 30}]
    seeds = tasks.where("seq = 1")
    found = []
    for plan in plans:
        with limits(**plan):
            found.append(
                [
                    rows(order.fifo_order(tasks, edges), "graph_id", "task_id", "level", "position"),
                    rows(order.levels(tasks, edges), "graph_id", "task_id", "level"),
                    rows(cycles.cycle_members(tasks, edges), "graph_id", "task_id", "scc_id", "in_cycle"),
                    rows(reach.reachable(edges, seeds), "graph_id", "seed_id", "task_id", "hops"),
                    sorted(map(repr, reach.probe_cycles(edges, edges.select(*reach.PROBE)).collect())),
                ]
            )
    forced = [
        rows(order.fifo_order(tasks, edges, plan="rounds"), "graph_id", "task_id", "level", "position"),
        rows(order.levels(tasks, edges, plan="rounds"), "graph_id", "task_id", "level"),
        rows(cycles.cycle_members(tasks, edges, plan="rounds"), "graph_id", "task_id", "scc_id", "in_cycle"),
        rows(reach.reachable(edges, seeds, plan="rounds"), "graph_id", "seed_id", "task_id", "hops"),
        sorted(map(repr, reach.probe_cycles(edges, edges.select(*reach.PROBE), plan="rounds").collect())),
    ]
    assert len(found[0][1]) == 42 and all(f == found[0] for f in [*found, forced])


def test_frozen_graphs_stay_frozen(spark):
    graphs = spark.createDataFrame([(1, True), (2, False), (3, None)], "graph_id long, finalised boolean")
    tasks, edges = tasks_df(spark, [(g, t, t) for g in (1, 2, 3) for t in (1, 2)]), edges_df(spark, [(g, i, a, b) for g in (1, 2, 3) for i, a, b in ((1, 1, 2), (2, 2, 1))])
    assert rows(order.validate_graphs(graphs, tasks, edges)) == [(1, True, "ok"), (2, False, "no_root"), (3, False, "no_root")]


@pytest.fixture
def written(monkeypatch):
    """(name, rows) of every scratch table written."""
    seen, put = [], Scratch.put

    def noted(self, df, name, *args, **metrics):
        result = put(self, df, name, *args, **metrics)
        seen.append((name, result[1]["rows"]))
        return result

    monkeypatch.setattr(Scratch, "put", noted)
    return seen


def layered(n_layers, width, rng):
    """Each task waits for three tasks of the layer before, and for one of any earlier layer."""
    tasks = [(1, t + 1, t) for t in range(n_layers * width)]
    edges = set()
    for t in range(width, n_layers * width):
        layer = t // width
        for _ in range(3):
            edges.add((t + 1, (layer - 1) * width + rng.randrange(width) + 1))
        edges.add((t + 1, rng.randrange(layer * width) + 1))
    return tasks, [(1, i, late, early) for i, (late, early) in enumerate(sorted(edges))]


def test_ranked_rounds_write_tasks_when_touched_only(spark, limits, written):
    tasks, edges = layered(14, 12, random.Random(2))
    tdf, edf = tasks_df(spark, tasks), edges_df(spark, edges)
    with limits(bucketRows=20):
        found = rows(order.fifo_order(tdf, edf, plan="rounds"), "graph_id", "task_id", "level", "position")
    assert {(g, t): (level, at) for g, t, level, at in found} == queue_run(tasks, edges)
    steps = sum(n for name, n in written if name.startswith("steps/"))
    merged = sum(n for name, n in written if name.startswith("log-"))
    links = sum(n for name, n in written if name.startswith("links-"))
    rounds = sum(name.startswith("steps/") for name, _ in written)
    assert rounds == 14 and steps <= len(edges) + 12 and merged <= 2 * steps and links <= 2 * len(edges)
    # Rewriting all waiting tasks in every round takes several times as many rows.
    assert steps + merged < 14 * len(tasks) / 2


def test_ranked_rounds_take_runs_of_levels(spark, limits, written):
    n = 100
    # A chain with a task beside each of its tasks, which runs before it or after it.
    pairs = [(t, t - 2) for t in range(3, n + 1)] + [(t, t - 3) for t in range(5, n + 1, 2)]
    tdf, edf = graph(spark, n, pairs)
    with limits(bucketRows=60):
        found = rows(order.fifo_order(tdf, edf, plan="rounds"), "graph_id", "task_id", "level", "position")
    assert {(g, t): (level, at) for g, t, level, at in found} == queue_run([(1, t, t) for t in range(1, n + 1)], [(1, i, a, b) for i, (a, b) in enumerate(pairs)])
    # Fifty levels, three runs of them.
    assert sum(name.startswith("steps/") for name, _ in written) <= 3


def test_blocks_take_a_round_per_change_of_block(spark, limits, written):
    n = 600
    tdf, edf = graph(spark, n, [(t, t - 1) for t in range(2, n + 1)])
    with limits(bucketRows=300):
        found = rows(order.levels(tdf, edf, plan="rounds"), "task_id", "level")
    assert found == [(t, t - 1) for t in range(1, n + 1)]
    # 600 tasks and 599 links in blocks of 300.
    assert sum(name.startswith("steps/") for name, _ in written) == 4


def test_blocks_move_messages_not_tasks(spark, limits, written):
    n = 600
    # A chain through four blocks, and a hub whose links are more than a block holds.
    tasks = [(g, t, t) for g in (1, 2) for t in range(1, n + 1)]
    edges = [(1, t, t, t - 1) for t in range(2, n + 1)] + [(2, t, t, 7) for t in range(8, n + 1)]
    with limits(bucketRows=300):
        found = rows(order.levels(tasks_df(spark, tasks), edges_df(spark, edges), plan="rounds"), "graph_id", "task_id", "level")
    assert found == [(1, t, t - 1) for t in range(1, n + 1)] + [(2, t, int(t > 7)) for t in range(1, n + 1)]
    # A row of arrays and rows of state per block, the chain's three messages, the hub: tasks are not written again.
    assert sum(rows for name, rows in written if name.startswith("steps/")) < 30


def test_a_scrambled_chain_is_contracted_in_log_rounds(spark, written):
    n, rng = 3000, random.Random(1)
    ids = rng.sample(range(1, n + 1), n)
    tdf, edf = graph(spark, n, [(late, early) for early, late in zip(ids, ids[1:])])
    found = dict(rows(order.levels(tdf, edf, plan="chains"), "task_id", "level"))
    assert found == {t: at for at, t in enumerate(ids)}
    # Twelve jumps cover 3,000 tasks; one more sees that nothing moves, and two contractions have a start.
    assert sum(name.startswith("pointers-") for name, _ in written) == 15


def test_contraction_of_trees_diamonds_and_circles(spark):
    pairs = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 5), (6, 4), (7, 6)]  # a chain of diamonds
    pairs += [(8, 7), (9, 7), (10, 9), (11, 7)]  # a tree on top
    pairs += [(12, 13), (13, 14), (14, 12), (15, 14), (16, 15), (17, 16), (17, 11)]  # a circle and what hangs on it
    pairs += [(18, 99), (19, 18), (20, 21), (21, 20)]  # an unknown dependency, a circle of two
    tdf, edf = graph(spark, 22, pairs)
    plain = {t: level for (_, t), (level, _) in queue_run([(1, t, t) for t in range(1, 23)], [(1, i, a, b) for i, (a, b) in enumerate(pairs)]).items()}
    assert dict(rows(order.levels(tdf, edf, plan="chains"), "task_id", "level")) == plain


def test_chains_within_a_range_of_ids_take_no_rounds(spark, limits, written):
    n = 3000
    tdf, edf = graph(spark, n, [(t, t - 1) for t in range(2, n + 1)])
    with limits(bucketRows=300):
        found = dict(rows(order.levels(tdf, edf, plan="chains"), "task_id", "level"))
    assert found == {t: t - 1 for t in range(1, n + 1)}
    # A chain over ten ranges or fewer: four jumps, and one that sees that nothing moves; two contractions have a start.
    assert sum(name.startswith("pointers-") for name, _ in written) <= 7
    # Only pointers that moved are joined again: 12,991 rows, not six times all.
    assert sum(rows for name, rows in written if name.startswith("pointers-")) < 5 * n


def test_contraction_by_ranges_with_circles(spark, limits):
    pairs = [(t, t - 1) for t in range(2, 13)]
    pairs += [(13, 17), (14, 13), (15, 14), (16, 15), (17, 16), (18, 17), (19, 18), (20, 21), (21, 20), (22, 12)]
    tdf, edf = graph(spark, 22, pairs)
    with limits(bucketRows=3):
        found = dict(rows(order.levels(tdf, edf, plan="chains"), "task_id", "level"))
    assert found == {**{t: t - 1 for t in range(1, 13)}, **dict.fromkeys(range(13, 22)), 22: 12}
