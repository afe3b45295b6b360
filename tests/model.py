"""A plain statement of the semantics, one edge and one task at a time."""

from collections import deque


def rows(df, *columns):
    """Sorted tuples of the given columns (all of them by default); NULL sorts first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, v) for v in r])


def reaches(links, start, goal):
    seen, todo = set(), [start]
    while todo:
        node = todo.pop()
        if node == goal:
            return True
        if node not in seen:
            seen.add(node)
            todo.extend(links.get(node, ()))
    return False


def admit(tasks, offers):
    """Verdict per offer: offers are (seq, graph1, dependent, graph2, dependency) in order."""
    accepted, verdicts = {}, {}
    for seq, g1, late, g2, early in sorted(offers):
        links = accepted.setdefault(g1, {})
        if not late or not early:
            verdict = "invalid_handle"
        elif g1 != g2:
            verdict = "cross_graph"
        elif late == early:
            verdict = "self"
        elif (g1, late) not in tasks or (g2, early) not in tasks:
            verdict = "missing"
        elif reaches(links, early, late):
            verdict = "cycle"
        elif early in links.get(late, ()):
            verdict = "duplicate"
        else:
            verdict = "ok"
            links.setdefault(late, []).append(early)
        verdicts[seq] = verdict
    return verdicts


def queue_run(tasks, edges):
    """{(graph, task): (level, position)}: a first-in-first-out run of every graph.

    ``tasks`` are (graph, task, seq), ``edges`` (graph, edge_seq, dependent, dependency).
    """
    result = {}
    for graph in {g for g, _, _ in tasks}:
        names = [t for _, t, _ in sorted((r for r in tasks if r[0] == graph), key=lambda r: r[2])]
        own = sorted(e for e in edges if e[0] == graph)
        left = {t: sum(1 for e in own if e[2] == t) for t in names}
        level = {t: 0 for t in names}
        queue, position = deque(t for t in names if not left[t]), 0
        while queue:
            task = queue.popleft()
            position += 1
            result[graph, task] = (level[task], position)
            for _, _, late, early in own:
                if early == task and late in left:
                    left[late] -= 1
                    level[late] = level[task] + 1
                    if not left[late]:
                        queue.append(late)
        for task in names:
            result.setdefault((graph, task), (None, None))
    return result


def knots(tasks, edges):
    """{(graph, task): (stuck, core, scc_id, in_cycle)} by closing all paths."""
    result = {}
    for graph in {g for g, _, _ in tasks}:
        names = [t for g, t, _ in tasks if g == graph]
        links = {}
        for g, _, late, early in edges:
            if g == graph:
                links.setdefault(late, []).append(early)
        paths = {(a, b) for a in names for b in names if any(reaches(links, n, b) for n in links.get(a, ()))}
        cyclic = {t for t in names if (t, t) in paths}
        for t in names:
            mates = {u for u in names if (t, u) in paths and (u, t) in paths} | {t}
            below = t in cyclic or any((t, c) in paths for c in cyclic)
            above = t in cyclic or any((c, t) in paths for c in cyclic)
            result[graph, t] = (below, below and above, min(mates), t in cyclic)
    return result


def random_graphs(random, n_graphs, n_tasks, n_edges, acyclic):
    """Tasks with scrambled insertion order and distinct edges with scrambled edge order."""
    tasks, edges, order = [], [], list(range(n_graphs * n_edges))
    random.shuffle(order)
    for g in range(1, n_graphs + 1):
        seqs = random.sample(range(1000), n_tasks)
        tasks += [(g, t + 1, seqs[t]) for t in range(n_tasks)]
        pairs = set()
        for _ in range(n_edges):
            a, b = random.sample(range(1, n_tasks + 1), 2)
            pairs.add((max(a, b), min(a, b)) if acyclic else (a, b))
        edges += [(g, order.pop(), late, early) for late, early in sorted(pairs)]
    return tasks, edges
