"""Array helpers run inside one grouped task, on a pack of small graphs at a time."""

import numpy as np


def finder(graphs, ids):
    """Return ``find(graphs, ids)`` giving row positions in the given arrays, -1 if absent."""
    known_graphs, known_ids = np.unique(graphs), np.unique(ids)
    keys = np.searchsorted(known_graphs, graphs) * len(known_ids) + np.searchsorted(known_ids, ids)
    by_key = np.argsort(keys, kind="stable")
    sorted_keys = keys[by_key]

    def find(wanted_graphs, wanted_ids):
        if not len(keys):
            return np.full(len(wanted_ids), -1)
        g = np.searchsorted(known_graphs, wanted_graphs).clip(max=len(known_graphs) - 1)
        i = np.searchsorted(known_ids, wanted_ids).clip(max=len(known_ids) - 1)
        wanted = g * len(known_ids) + i
        at = np.searchsorted(sorted_keys, wanted).clip(max=len(keys) - 1)
        hit = (known_graphs[g] == wanted_graphs) & (known_ids[i] == wanted_ids) & (sorted_keys[at] == wanted)
        return np.where(hit, by_key[at], -1)

    return find


def nodes_of(graphs, ids):
    """The distinct (graph, id) pairs, each graph's nodes stored together."""
    order = np.lexsort((ids, graphs))
    graphs, ids = graphs[order], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (graphs[1:] != graphs[:-1]) | (ids[1:] != ids[:-1])
    return graphs[new], ids[new]


class Links:
    """Outgoing links of ``n`` nodes; links of a node keep the order they are given in."""

    def __init__(self, n, source, target):
        by_source = np.argsort(source, kind="stable")
        self.target = target[by_source]
        self.first = np.searchsorted(source[by_source], np.arange(n + 1))

    def follow(self, nodes):
        """(index into nodes, target) of all links of ``nodes``, node by node."""
        counts = self.first[nodes + 1] - self.first[nodes]
        origin = np.repeat(np.arange(len(nodes)), counts)
        offset = np.arange(len(origin)) - np.repeat(counts.cumsum() - counts, counts)
        return origin, self.target[self.first[nodes][origin] + offset]


def release(links, wave, waiting):
    """Release nodes wave by wave, starting from the ordered ``wave``.

    ``waiting`` holds the unmet dependencies of every node. A node joins the next wave at
    the moment its last dependency is visited, so the waves come out in queue order.
    Returns the level of every node (-1 if never released) and all released nodes in order.
    """
    level, stamp = np.full(len(waiting), -1), np.zeros(len(waiting), dtype=np.int64)
    waves = []
    while len(wave):
        level[wave] = len(waves)
        waves.append(wave)
        _, hit = links.follow(wave)
        np.subtract.at(waiting, hit, 1)
        visit = np.arange(len(hit))
        np.maximum.at(stamp, hit, visit)
        final = stamp[hit] == visit
        stamp[hit] = 0
        wave = hit[final & (waiting[hit] == 0)]
    return level, np.concatenate(waves) if waves else np.empty(0, dtype=np.int64)


def peel(n, dependency, dependent):
    """True for the nodes left when all nodes without unmet dependencies are removed."""
    waiting = np.bincount(dependent, minlength=n)
    level, _ = release(Links(n, dependency, dependent), np.flatnonzero(waiting == 0), waiting)
    return level < 0


def components(n, source, target):
    """A component number per node: nodes on a common cycle share one (one-pass, linear)."""
    links = Links(n, source, target)
    first, targets = links.first.tolist(), links.target.tolist()
    cursor, found, low = first[:n], [0] * n, [0] * n
    component, open_nodes, clock, count = [-1] * n, [], 0, 0
    for root in range(n):
        if found[root]:
            continue
        path = [root]
        while path:
            node = path[-1]
            if not found[node]:
                clock += 1
                found[node] = low[node] = clock
                open_nodes.append(node)
            if cursor[node] < first[node + 1]:
                other = targets[cursor[node]]
                cursor[node] += 1
                if not found[other]:
                    path.append(other)
                elif component[other] < 0:
                    low[node] = min(low[node], found[other])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[node])
            if low[node] == found[node]:
                while component[node] < 0:
                    component[open_nodes.pop()] = count
                count += 1
    return np.array(component, dtype=np.int64)


def admit(n, dependent, dependency, fixed):
    """Take edges in order; False for each edge that would close a cycle of accepted edges.

    Edges marked ``fixed`` are known to be accepted. A topological place is kept per node,
    so only the nodes between the two ends of an edge are ever searched, and moved.
    """
    after, before = [set() for _ in range(n)], [set() for _ in range(n)]
    waiting = np.bincount(dependent[fixed], minlength=n)
    links = Links(n, dependency[fixed], dependent[fixed])
    _, order = release(links, np.flatnonzero(waiting == 0), waiting)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    for late, early in zip(dependent[fixed].tolist(), dependency[fixed].tolist()):
        after[early].add(late)
        before[late].add(early)

    def reach(start, neighbours, inside):
        seen, todo = {start}, [start]
        while todo:
            for other in neighbours[todo.pop()]:
                if other not in seen and inside(place[other]):
                    seen.add(other)
                    todo.append(other)
        return seen

    accepted = np.ones(len(dependent), dtype=bool)
    for i in np.flatnonzero(~fixed).tolist():
        late, early = int(dependent[i]), int(dependency[i])
        if place[early] > place[late]:
            highest, lowest = place[early], place[late]
            forward = reach(late, after, lambda p: p <= highest)
            if early in forward:
                accepted[i] = False
                continue
            backward = reach(early, before, lambda p: p >= lowest)
            moved = sorted(backward, key=place.__getitem__) + sorted(forward, key=place.__getitem__)
            for node, spot in zip(moved, sorted(place[node] for node in moved)):
                place[node] = spot
        after[early].add(late)
        before[late].add(early)
    return accepted


def spread(links, starts, spans, offsets, allowed=None, max_hops=None):
    """Breadth-first search from many starts at once.

    Search ``i`` starts at node ``starts[i]``; ``spans[i]`` nodes beginning at node
    ``offsets[i]`` are the only ones it can meet (the nodes of its graph, stored together).
    ``allowed(search, node)`` prunes. Returns (search, node, hops) of everything met.
    """
    base = spans.cumsum() - spans
    seen = np.zeros(int(spans.sum()), dtype=bool)
    search, node, hops, met = np.arange(len(starts)), starts, 0, []
    while len(search):
        seen[base[search] + node - offsets[search]] = True
        met.append((search, node, np.full(len(search), hops)))
        if hops == max_hops:
            break
        origin, node = links.follow(node)
        search = search[origin]
        spot = base[search] + node - offsets[search]
        fresh = ~seen[spot]
        if allowed is not None:
            fresh &= allowed(search, node)
        _, one_each = np.unique(spot[fresh], return_index=True)
        search, node, hops = search[fresh][one_each], node[fresh][one_each], hops + 1
    if not met:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*met))
