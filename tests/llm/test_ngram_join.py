import random
import re
from collections import Counter

import pytest
from depweave.llm import ngram_join
from depweave.llm.components import components
from depweave.plans.scratch import Scratch


def brute(rows, size, percent):
    """Links between all pairs of ids, one set per id."""
    sets, parent = {}, {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(i, grams)
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(sets[i]), top(i) if i is not None else None) for i, *_ in rows)


def got(docs, size, percent):
    rows = ngram_join.NgramJoin(docs, size, percent).grouped().collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_equals_brute_force(table_of, awkward, size, percent):
    rows = [r for r in awkward if r[0] is not None]
    assert got(table_of(rows), size, percent) == brute(rows, size, percent)


def chains():
    """Texts drifting away from each other by one word at a time, so groups are chains of links."""
    draw = random.Random(4)
    rows, n = [], 0
    for _ in range(4):
        words = [f"w{draw.randrange(500)}" for _ in range(90)]
        for _ in range(25):
            for _ in range(draw.choice([1, 1, 1, 2])):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10_000)}"
            rows.append(((n * 37) % 1009, " ".join(words), "en", "a"))
            n += 1
    return rows


def test_chains_beyond_the_head_of_a_bucket(table_of):
    rows = chains()
    want = brute(rows, 4, 85)
    assert got(table_of(rows), 4, 85) == want
    assert 4 < len({c for _, _, c in want}) < 60


def test_hot_buckets_give_the_same(table_of, limits):
    rows = chains()
    with limits(hotRows=1):
        assert got(table_of(rows), 4, 85) == brute(rows, 4, 85)


def test_null_and_repeated_ids(table_of, awkward):
    rows = ngram_join.NgramJoin(table_of(awkward)).grouped().collect()
    assert len(rows) == len(awkward)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert len({r.component_id for r in rows if r.doc_id == 3}) == 1
    assert got(table_of([]), 4, 85) == Counter()


def test_components_of_paths_and_stars(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    links += [(500 + draw.randrange(60), 500 + draw.randrange(60)) for _ in range(40)]
    parent = {n: n for link in links for n in link}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(links, "a long, b long")
    found = dict(map(tuple, components(frame, Scratch(spark, "test"), "t").collect()))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: top(n) for n in nodes}


def counting(monkeypatch):
    """How many pairs each step verifies, by its name."""
    tried, verified = {}, ngram_join.NgramJoin._verified

    def counted(self, pairs, name):
        found = verified(self, pairs, name)
        tried[name] = found[1]["rows"]
        return found

    monkeypatch.setattr(ngram_join.NgramJoin, "_verified", counted)
    return tried


def test_turns_before_the_last_step_give_the_same(table_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "MANY_OUTSIDE", 0)
    tried, rows = counting(monkeypatch), chains()
    assert got(table_of(rows), 4, 85) == brute(rows, 4, 85)
    assert 0 < tried["turn-1"] <= len(rows)


def test_a_group_without_a_centre_makes_few_pairs(table_of, monkeypatch):
    """Copies of a text that is not there, most pairs of them just below the threshold."""
    draw, tried = random.Random(9), counting(monkeypatch)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(100):
        copy = list(words)
        for at in draw.sample(range(200), 2):
            copy[at] = f"x{i}.{at}"
        rows.append(((i * 37) % 1009, " ".join(copy), "en", "a"))
    assert got(table_of(rows), 4, 85) == brute(rows, 4, 85)
    assert sum(tried.values()) < 100 * 99 / 2 / 4


def test_fragments_of_many_pairs_are_not_broadcast(table_of, monkeypatch, limits):
    plans, put, rows = {}, Scratch.put, chains()

    def noted(self, df, name, *args, **metrics):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return put(self, df, name, *args, **metrics)

    monkeypatch.setattr(Scratch, "put", noted)
    with limits(broadcastRows=8):
        assert got(table_of(rows), 4, 85) == brute(rows, 4, 85)
    assert re.search(r"SortMergeJoin \[a#\d+L, fragment#", plans["first-verified"])
