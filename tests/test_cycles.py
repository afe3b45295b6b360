import random

import numpy as np
import pytest
from frames_of import edges_df, graph, offers_df, offers_in_graph_1, tasks_df
from model import admit, knots, queue_run, random_graphs, reaches, rows

from depweave.operators import cycles, edges as edge_ops, reach
from depweave.plans.mergelog import Buckets, MergeLog
from depweave.plans.scratch import Scratch

PLANS = {"packs": {}, "rounds": {"graphRows": 1}}


@pytest.mark.parametrize("plan", PLANS)
def test_cyclic_parts_of_random_graphs(spark, limits, plan):
    tasks, edges = random_graphs(random.Random(11), 3, 9, 12, acyclic=False)
    with limits(**PLANS[plan]):
        tdf, edf = tasks_df(spark, tasks), edges_df(spark, edges)
        members = rows(cycles.cycle_members(tdf, edf), "graph_id", "task_id", "scc_id", "in_cycle")
    labels = {(g, t): (scc, cyclic) for g, t, scc, cyclic in members}
    assert labels == {key: value[2:] for key, value in knots(tasks, edges).items()}


@pytest.mark.parametrize("plan", PLANS)
def test_stuck_and_core_of_random_graphs(spark, limits, plan):
    tasks, edges = random_graphs(random.Random(12), 2, 10, 13, acyclic=False)
    with limits(**PLANS[plan]):
        core = rows(cycles.cyclic_core(tasks_df(spark, tasks), edges_df(spark, edges)), "graph_id", "task_id", "stuck", "core")
    found = {(g, t): (stuck, in_core) for g, t, stuck, in_core in core}
    assert found == {key: value[:2] for key, value in knots(tasks, edges).items()}


def test_long_cycle_by_rounds(spark, limits):
    n = 12
    tasks, edges = graph(spark, n, [(t % n + 1, t) for t in range(1, n + 1)])
    with limits(graphRows=1):
        found = rows(cycles.cycle_members(tasks, edges), "scc_id", "in_cycle")
    assert found == [(1, True)] * n


@pytest.mark.parametrize(
    "plan, direction, max_hops",
    [("packs", "up", None), ("packs", "down", None), ("packs", "up", 0), ("rounds", "up", None), ("rounds", "down", 2)],
)
def test_reachable_tasks_and_hops(spark, limits, plan, direction, max_hops):
    tasks, edges = random_graphs(random.Random(5), 3, 10, 14, acyclic=False)
    seeds = [(1, 1), (1, 4), (2, 3), (9, 5)]
    expected = set()
    for g, start in seeds:
        wave, seen, hops = {start}, {start}, 0
        while wave and (max_hops is None or hops <= max_hops):
            expected |= {(g, start, t, hops) for t in wave}
            pairs = [(late, early) if direction == "up" else (early, late) for h, _, late, early in edges if h == g]
            wave = {b for a, b in pairs if a in wave} - seen
            seen |= wave
            hops += 1
    with limits(**PLANS[plan]):
        seeds_df = spark.createDataFrame(seeds, "graph_id long, task_id long")
        found = rows(reach.reachable(edges_df(spark, edges), seeds_df, direction, max_hops))
    assert found == sorted(expected)


def test_waves_are_few_files_however_many_buckets_they_meet(spark, limits, monkeypatch):
    n, rng = 400, random.Random(6)
    tasks, edges = graph(spark, n, sorted({(t, rng.randrange(1, t)) for t in range(2, n + 1)}))
    seeds = tasks.where("task_id % 3 = 0").select("graph_id", "task_id")
    add, files = MergeLog.add, []
    monkeypatch.setattr(MergeLog, "add", lambda self, table, rows, drop=None: files.append(len(table.inputFiles())) or add(self, table, rows, drop))
    plain = rows(reach.reachable(edges, seeds))
    with limits(bucketRows=40):
        assert rows(reach.reachable(edges, seeds, plan="rounds")) == plain
    # Nine buckets, two shuffle partitions.
    assert files and max(files) <= 2


def test_many_searches_share_rows_and_hops_read_the_buckets_they_touch(spark, limits, monkeypatch):
    n, rng = 400, random.Random(6)
    pairs = {(t, t - 1) for t in range(2, n + 1)} | {(rng.randrange(2, n + 1), 1) for _ in range(60)} | {(1, n)}
    tasks, edges = graph(spark, n, sorted(pairs))
    seeds = tasks.where("task_id % 3 = 0").select("graph_id", "task_id")
    named, read = Buckets.named, []

    def noted(self, seen):
        found = named(self, seen)
        read.append((len(found), self.n))
        return found

    plain = rows(reach.reachable(edges, seeds, max_hops=9))
    last = tasks.where("task_id = 200").select("graph_id", "task_id")
    alone = rows(reach.reachable(edges, last, max_hops=9))
    with limits(bucketRows=40):
        assert rows(reach.reachable(edges, seeds, max_hops=9, plan="rounds")) == plain
        monkeypatch.setattr(Buckets, "named", noted)
        assert rows(reach.reachable(edges, last, max_hops=9, plan="rounds")) == alone
    # One search along a chain: a few of the buckets for its edges and what it visited.
    assert len(plain) > 1000 and read and all(few <= 2 < of for few, of in read)


@pytest.mark.parametrize("plan", PLANS)
def test_probes_look_at_the_present_graph_only(spark, limits, plan):
    rng = random.Random(6)
    _, edges = random_graphs(rng, 2, 12, 18, acyclic=True)
    edges += [(3, i, late, early) for _, i, late, early in random_graphs(rng, 1, 12, 18, acyclic=False)[1]]
    probes = [(g, late, early) for g in (1, 2, 3, 4) for late in range(1, 14) for early in range(1, 14)]
    expected = []
    for g, late, early in probes:
        links = {}
        for h, _, a, b in edges:
            if h == g:
                links.setdefault(a, []).append(b)
        expected.append((g, late, early, reaches(links, early, late)))
    with limits(**PLANS[plan]):
        cand = spark.createDataFrame(probes, "graph_id long, dependent_id long, dependency_id long")
        assert rows(reach.probe_cycles(edges_df(spark, edges), cand)) == sorted(expected)


@pytest.mark.parametrize(
    "pairs, verdicts",
    [
        ([(2, 1), (1, 2)], ["ok", "cycle"]),
        ([(2, 1), (3, 2), (1, 3)], ["ok", "ok", "cycle"]),
        ([(2, 1), (1, 2), (1, 2)], ["ok", "cycle", "cycle"]),
        ([(2, 1), (2, 1), (1, 1), (0, 1), (9, 1)], ["ok", "duplicate", "self", "invalid_handle", "missing"]),
    ],
)
def test_small_admissions(spark, pairs, verdicts):
    tasks, _ = graph(spark, 3, [])
    found = rows(cycles.admit_edges(offers_in_graph_1(spark, pairs), tasks), "seq", "verdict", "accepted")
    assert [r[1] for r in found] == verdicts
    assert all(accepted == (verdict == "ok") for _, verdict, accepted in found)


def dirty_offers(rng, n_graphs, n_tasks, n):
    return [
        (seq, g, rng.randrange(n_tasks + 2), g + (rng.random() < 0.05), rng.randrange(n_tasks + 2))
        for seq, g in enumerate(rng.choices(range(1, n_graphs + 1), k=n))
    ]


@pytest.mark.parametrize(
    "plan",
    [{}, {"admitRows": 15}, {"admitRows": 15, "graphRows": 10}, {"admitRows": 4}],
    ids=["packs", "components", "components by rounds", "batches"],
)
def test_admission_equals_one_by_one(spark, limits, plan):
    rng = random.Random(8)
    n_graphs, n_tasks, n = {4: (1, 5, 40), 10: (1, 8, 40)}.get(min(plan.values(), default=0), (3, 9, 120))
    offers = dirty_offers(rng, n_graphs, n_tasks, n)
    tasks = [(g, t, t) for g in range(1, n_graphs + 1) for t in range(1, n_tasks + 1)]
    expected = admit({(g, t) for g, t, _ in tasks}, offers)
    with limits(**plan):
        found = rows(cycles.admit_edges(offers_df(spark, offers), tasks_df(spark, tasks)), "seq", "verdict")
    assert dict(found) == expected
    assert "cycle" in expected.values()


def test_a_pack_is_decided_a_few_graphs_at_a_time(monkeypatch):
    rng, sizes, admit_some = np.random.default_rng(4), [], cycles.kernels.admit
    n = 90_000
    pack = {"graph_id": rng.integers(1, 3000, n), "edge_seq": rng.permutation(n), "dependent_id": rng.integers(1, 9, n)}
    pack |= {"dependency_id": rng.integers(1, 9, n), "fixed": np.zeros(n, dtype=bool)}
    monkeypatch.setattr(cycles, "TOGETHER", n)
    whole = cycles._admit_pack(pack)
    monkeypatch.undo()
    monkeypatch.setattr(cycles.kernels, "admit", lambda n, late, *rest: sizes.append(len(late)) or admit_some(n, late, *rest))
    parts = cycles._admit_pack(pack)
    assert all((whole[name] == parts[name]).all() for name in whole) and not whole["accepted"].all()
    assert sum(sizes) == n and max(sizes) < 21_000


def test_many_random_admissions(spark):
    for seed in range(3):
        rng = random.Random(seed)
        offers = dirty_offers(rng, 40, 8, 1500)
        tasks = [(g, t, t) for g in range(1, 41) for t in range(1, 9)]
        found = rows(cycles.admit_edges(offers_df(spark, offers), tasks_df(spark, tasks)), "seq", "verdict")
        assert dict(found) == admit({(g, t) for g, t, _ in tasks}, offers)


def test_accepted_edges_are_acyclic_and_frozen_graphs_refuse(spark):
    rng = random.Random(2)
    offers = dirty_offers(rng, 4, 10, 300)
    tasks = [(g, t, t) for g in range(1, 5) for t in range(1, 11)]
    graphs = spark.createDataFrame([(1, True), (2, False)], "graph_id long, finalised boolean")
    judged = cycles.admit_edges(offers_df(spark, offers), tasks_df(spark, tasks), graphs)
    assert {r[0] for r in rows(judged.where("dependent_graph_id = 1"), "verdict")} == {"finalised"}
    kept = rows(edge_ops.as_edges(judged.where("accepted")))
    assert all(level is not None for level, _ in queue_run(tasks, kept).values())


@pytest.mark.parametrize("batch", [2, 100])
def test_halves_and_batches_are_exact(spark, limits, batch):
    """Offers with equal and missing places in the order; every component counts as beyond one task."""
    rng = random.Random(3)
    n_tasks = 6
    edges = rng.sample([(a, b) for a in range(1, n_tasks + 1) for b in range(1, n_tasks + 1)], 22)
    seqs = [None, None, *sorted(rng.choice([1, 1, 2, 3, 3, 3]) for _ in range(20))]
    offers = [(seq, 1, late, 1, early) for seq, (late, early) in zip(seqs, edges)]
    ordered = sorted(offers, key=lambda o: (o[0] is not None, o[0] or 0, o[2], o[4]))
    expected = admit({(1, t) for t in range(1, n_tasks + 1)}, [(i, *o[1:]) for i, o in enumerate(ordered)])
    cand = spark.createDataFrame(offers, "seq long, dependent_graph_id long, dependent_id long, dependency_graph_id long, dependency_id long")
    tasks = tasks_df(spark, [(1, t, t) for t in range(1, n_tasks + 1)])
    found = {(r[0], r[1]): r[2] for r in rows(cycles.admit_edges(cand, tasks, plan="rounds", batch=batch), "dependent_id", "dependency_id", "verdict")}
    assert found == {(o[2], o[4]): expected[i] for i, o in enumerate(ordered)}
    assert "cycle" in expected.values()


def test_batches_follow_fixed_edges(spark, limits):
    """A long accepted chain; later offers close it or not."""
    chain = [(t + 1, t) for t in range(1, 12)]
    more = [(1, 12), (13, 12), (1, 13), (5, 9), (9, 5), (14, 13), (2, 14), (6, 1)]
    offers = [(i, 1, late, 1, early) for i, (late, early) in enumerate(chain + more)]
    tasks = [(1, t, t) for t in range(1, 15)]
    found = rows(cycles.admit_edges(offers_df(spark, offers), tasks_df(spark, tasks), plan="rounds", batch=5), "seq", "verdict")
    assert dict(found) == admit({(1, t) for t in range(1, 15)}, offers)


def test_a_row_of_cycles_takes_few_turns(spark, limits, monkeypatch):
    """Forty cycles of two with rising ids, each waiting for the one before."""
    turns, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name, *a, **k: turns.append(name) or put(self, df, name, *a, **k))
    pairs = [(2 * k, 2 * k - 1) for k in range(1, 41)] + [(2 * k - 1, 2 * k) for k in range(1, 41)]
    pairs += [(2 * k + 1, 2 * k) for k in range(1, 40)]
    tasks, edges = graph(spark, 80, pairs)
    found = rows(cycles.cycle_members(tasks, edges, plan="rounds"), "task_id", "scc_id", "in_cycle")
    assert found == [(t, t - 1 + t % 2, True) for t in range(1, 81)]
    assert sum(name.startswith("both-") for name in turns) <= 12


def test_a_search_ends_with_its_hit(spark, monkeypatch):
    """Task 1 waits for 2, the one sought, and for a chain of 20 tasks; the search does not walk the chain."""
    from depweave.operators import reach
    from depweave.plans.scratch import Scratch

    chain = [(1, 10)] + [(i, i + 1) for i in range(10, 30)]
    edges = spark.createDataFrame([(7, i, a, b) for i, (a, b) in enumerate([(1, 2), *chain])], "graph_id long, edge_seq long, dependent_id long, dependency_id long")
    written, put = [], Scratch.put

    def noted(self, df, name, *args, **kw):
        found = put(self, df, name, *args, **kw)
        written.append((name, found[1]["rows"]))
        return found

    monkeypatch.setattr(Scratch, "put", noted)
    for offers, hops in (([(7, 2, 1)], 1), ([(7, 2, 1), (7, 1, 1)], 1), ([(7, 2, 1), (7, 12, 1)], 3), ([(7, 2, 1), (7, 30, 2)], 1)):
        written.clear()
        cand = spark.createDataFrame(offers, "graph_id long, dependent_id long, dependency_id long")
        found = {(r.dependent_id, r.dependency_id): r.would_cycle for r in reach.probe_cycles(edges, cand, plan="rounds").collect()}
        assert found == {(a, b): (a, b) != (30, 2) for _, a, b in offers}
        waves = [rows for name, rows in written if name.startswith("met/hop=")]
        assert sum(rows > 0 for rows in waves) - 1 <= hops and len(waves) <= hops + 2


def test_open_probes_are_written_once(spark, monkeypatch):
    """However many hops there are, a probe is written when it is asked and when it is answered."""
    n, written, put = 12, [], Scratch.put

    def noted(self, df, name, *args, **kw):
        found = put(self, df, name, *args, **kw)
        written.append((name, found[1]["rows"]))
        return found

    _, edges = graph(spark, n, [(t, t - 1) for t in range(2, n + 1)])
    cand = spark.createDataFrame([(1, 1, n), (1, n, 1), (1, n, 2), (1, 3, 8)], "graph_id long, dependent_id long, dependency_id long")
    monkeypatch.setattr(Scratch, "put", noted)
    assert rows(reach.probe_cycles(edges, cand, plan="rounds"), "dependent_id", "would_cycle") == [(1, True), (3, True), (n, False), (n, False)]
    assert sum(rows for name, rows in written if name.startswith(("sought", "answered"))) == 6
