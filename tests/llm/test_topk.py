import math

import numpy as np
import pytest
from depweave.llm import topk
from pyspark.sql import functions as F


def brute(rows, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= topk.TOO_LARGE for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        if i not in best or q < best[i]:
            best[i] = q
    out = set()
    for i, q in best.items():
        if i % 3 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in best.items() if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


def found(frame, k):
    return [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 3 == 0, k).collect()]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "SLICE_ROWS", 64)
    monkeypatch.setattr(topk, "PACK_ROWS", 16)
    draw = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in draw.normal(size=6).round(1)]) for i in range(200)]
    rows += [(i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(200, 260)]  # ties
    rows += [(300, None), (303, [1.0, None]), (306, [float("nan")]), (309, [float("inf"), 1.0]), (None, [1.0])]
    rows += [(312, []), (315, [1.5]), (318, [1e7]), rows[0], (3, [9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    got = found(frame, 7)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 7)


def test_clusters_stop_early(spark):
    """Far clusters have bounds below the k-th score, and are never evaluated."""
    draw = np.random.default_rng(3)
    x = (np.repeat(draw.normal(size=(20, 16)) * 3, 100, axis=0) + draw.normal(size=(2000, 16)) * 0.01).round(4)
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int32)
    square = int((x.astype(int) ** 2).sum(axis=1).max())
    table = topk.PivotTable(topk.choose_pivots(x, 32), square, 16)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, rows):
            seen.append(len(rows))
            return np.asarray(self)[rows]

    exact = table.exact(x)
    scores, ids = table.search(exact[0], 0, table.of_queries(x[:1])[0], exact.view(Watched), np.arange(2000), np.ascontiguousarray(table.of_candidates(x).T), 20)
    want = sorted(((-int(x[0].astype(int) @ x[j].astype(int)), j) for j in range(1, 2000)))[:20]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == want
    assert sum(seen) < 1000


def test_fewer_candidates_than_k_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, vector array<float>")
    assert found(frame, 20) == [(0, 1, 1, 64 * 128)]
    assert found(frame.where("vec_id > 5"), 20) == []


def test_large_finite_components_take_part(spark, monkeypatch):
    """Every finite vector is a query and a candidate; ranks are those of the exact integers."""
    monkeypatch.setattr(topk, "WIDE_ROWS", 2, raising=False)
    draw = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=3)]) for i in range(60)]
    large = [[2.0**20, 1.0, -3.0], [-(2.0**24), 0.0, 1.0], [2.0**40, -(2.0**39), 5.0], [3.0e38, 1.0, 1.0], [-3.0e38, -1.0], [1e9, 1e9, -1e9]]
    rows += [(60 + n, [float(np.float32(x)) for x in v]) for n, v in enumerate(large)]
    rows += [(66, rows[62][1]), (63, [3.2e38, 0.0, 0.0]), (63, [float("inf")]), (69, [None])]
    best = {}
    for i, v in rows:
        if all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * float(np.float32(x))) for x in v]
            best[i] = min(best.get(i, q), q)
    want = set()
    for i, q in best.items():
        scores = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in best.items() if j != i)[:20]
        want |= {(i, r + 1, j, -s if abs(s) < 1 << 63 else None) for r, (s, j) in enumerate(scores) if i % 3 == 0}
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    got = found(frame, 20)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(s is None for *_, s in want) and {60, 63, 66} <= {i for i, *_ in want}
    assert set(found(frame.where("vec_id IN (63, 64)"), 20)) == {(63, 1, 64, None)}


def test_sortable_keeps_the_order():
    values = sorted([0, 1, -1, 255, 256, -255, -256, -257, 1 << 300, -(1 << 300), (1 << 63) - 1, -(1 << 63)])
    assert sorted(values, key=topk.sortable) == values and len(set(map(topk.sortable, values))) == len(values)
