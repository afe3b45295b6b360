"""Exact top-k inner product search with a pivot table.

Vectors are whole numbers: floor(scale * component). One more component, sqrt(M^2 - |x|^2) with M
the largest norm, gives all candidates the same norm, and queries get a 0 there. Then the
distance d of a query and a candidate gives their inner product, (|q|^2 + M^2 - d^2) / 2, and
for every pivot p, d >= |d(q, p) - d(x, p)|. The distances of all candidates to ``PIVOTS`` pivots
are computed once. A query takes the largest of these bounds for each candidate, evaluates
candidates exactly in order of their bounds, and stops when the bound of the next one is below its
k-th best score. A small slack covers rounding, so the results are exact, ties included.

Queries are dealt into blocks of about ``QUERY_BLOCK`` and candidates into slices of about
``SLICE_ROWS``; each (block, slice) is one task of bounded memory, and the k best of the slices
are merged by rank. Pivots are chosen far from each other among the ``SAMPLE`` vectors with the
smallest hash of their id; any choice is right.

Vectors whose whole numbers have a squared norm of ``MOST_SQUARE`` or more are wide. As no inner
product of others can leave a long, only pairs with a wide vector are scored in Python integers,
each with each, and the results are merged by the integers themselves.

Defined results: vectors that are NULL, or hold a NULL or non-finite component, and rows without
an id take no part; a score beyond a long is NULL, its rank is that of the exact score; scale times a
component beyond the doubles (no float is) fails the query; of several rows of one id the one with the smallest vector counts; shorter
vectors are filled up with zeros; equal scores go to the smaller id; a query with fewer than k
candidates gets them all; an empty table gives no rows.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from depweave.plans.scratch import Scratch

PIVOTS = 32
SAMPLE = 2048
QUERY_BLOCK = 256
SLICE_ROWS = 1 << 16
PACK_ROWS = 1 << 13
WIDE_ROWS = 256
OBJECT_ROWS = 1 << 12
TOO_LARGE = float("inf")
MOST_SQUARE = float(1 << 61)
MOST_WHOLE = float(1 << 53)


def whole_vectors(rows, scale):
    """(vec_id, v, square): the vectors that take part, as arrays of whole numbers in doubles, and about their squared norms."""
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))

    def quantised(x):
        scaled = F.lit(float(scale)) * x.cast("double")
        beyond = F.raise_error(F.lit("scale times a component is beyond the doubles")).cast("double")
        # Doubles of that size are whole.
        large = F.when(F.abs(scaled) < float("inf"), scaled).otherwise(beyond)
        return F.when(F.abs(scaled) < MOST_WHOLE, F.floor(scaled).cast("double")).otherwise(large)

    # A NULL component makes forall NULL, which drops the row as well.
    taking = rows.where("vec_id IS NOT NULL AND vector IS NOT NULL").where(fits)
    taking = taking.select("vec_id", F.transform("vector", quantised).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return taking.withColumn("square", F.aggregate("v", F.lit(0.0), lambda total, c: total + c * c))


def integers(column, dimensions):
    """A list column of whole doubles as rows of Python integers."""
    out = np.full((len(column), dimensions), 0, dtype=object)
    for row, values in enumerate(column.to_pylist()):
        out[row, : len(values)] = [int(c) for c in values]
    return out


def sortable(score):
    """Bytes in the order of the integers: the sign, the length in bytes (its complement if negative), the bytes."""
    size = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return b"\x01" + size.to_bytes(2, "big") + score.to_bytes(size, "big")
    return b"\x00" + (0xFFFF - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def choose_pivots(sample, most):
    """Rows far from each other: each next one is the farthest from those before."""
    if not len(sample):
        return sample
    points = sample.astype(np.float64)
    norms = (points**2).sum(axis=1)
    chosen = [int(np.argmax(norms))]
    far = norms + norms[chosen[0]] - 2 * points @ points[chosen[0]]
    while len(chosen) < min(most, len(points)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, norms + norms[chosen[-1]] - 2 * points @ points[chosen[-1]])
    return points[chosen]


class PivotTable:
    """Distances to the pivots, of candidates and of queries."""

    def __init__(self, pivots, square, dimensions):
        """``square`` is the largest squared norm of all vectors."""
        self.pivots, self.square, self.dimensions = pivots, float(square), dimensions
        self.lift = np.sqrt(np.maximum(self.square - (pivots**2).sum(axis=1), 0))

    def matrix(self, column):
        """A list column as rows of equal length."""
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        out = np.zeros((len(sizes), self.dimensions), dtype=np.int32)
        out[np.arange(self.dimensions) < sizes[:, None]] = flat
        return out

    def of_candidates(self, x):
        x = x.astype(np.float64)
        lift = np.sqrt(np.maximum(self.square - (x**2).sum(axis=1), 0))
        d2 = 2 * self.square - 2 * (x @ self.pivots.T + np.outer(lift, self.lift))
        return np.sqrt(np.maximum(d2, 0)).astype(np.float32)

    def of_queries(self, q):
        q = q.astype(np.float64)
        d2 = (q**2).sum(axis=1, keepdims=True) + self.square - 2 * q @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0)).astype(np.float32)

    def exact(self, x):
        """A type in which all inner products are exact."""
        return x.astype(np.float32 if self.square <= 1 << 24 else np.float64 if self.square <= 1 << 52 else np.int64)

    def search(self, query, query_id, to_pivots, x, ids, table, k):
        """The k best (score, id) of one query among candidates ``x``; ``table`` has a row per pivot."""
        bound = np.zeros(len(ids), dtype=np.float32)
        for row, distance in zip(table, to_pivots):
            np.maximum(bound, np.abs(row - distance), out=bound)
        order = np.argsort(bound)
        most = (float((query.astype(np.float64) ** 2).sum()) + self.square) / 2
        slack = 1e-4 * self.square + 1
        best_scores, best_ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        done, step = 0, 4 * k + 64
        while done < len(order):
            if len(best_scores) >= k:
                above = most - float(bound[order[done]]) ** 2 / 2 + slack
                if above < best_scores[-1]:
                    break
            part = order[done : done + step]
            done, step = done + step, step * 4
            scores, who = (x[part] @ query).astype(np.int64), ids[part]
            if len(best_scores) >= k:
                hopeful = scores >= best_scores[-1]
                scores, who = scores[hopeful], who[hopeful]
            keep = who != query_id
            scores, who = np.concatenate([best_scores, scores[keep]]), np.concatenate([best_ids, who[keep]])
            if len(scores) > 4 * k:
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                scores, who = scores[scores >= floor], who[scores >= floor]
            ranked = np.lexsort((who, -scores))[:k]
            best_scores, best_ids = scores[ranked], who[ranked]
        return best_scores, best_ids


def wide_pairs(queries, candidates, seen, k, kind):
    """The k best of each slice of candidates for each query, in Python integers; one side is wide."""
    dimensions = seen["dimensions"]
    n_blocks, n_slices = -(-seen["queries"] // QUERY_BLOCK) or 1, -(-seen["rows"] // SLICE_ROWS) or 1
    n_slices = max(n_slices, -(-seen["wide"] // WIDE_ROWS))

    def dealt(rows, own, n_own, other, n_other):
        at = F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int").alias(own)
        return rows.select("vec_id", "v", at, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)).groupBy("block", "slice")

    def search(key, asked, held):
        out = {"query_id": [], "vec_id": [], "score": [], "key": []}
        ids, q = held.column("vec_id").to_pylist(), integers(asked.column("v"), dimensions)
        tops = [[] for _ in q]
        for start in range(0, len(ids), OBJECT_ROWS):
            x, who = integers(held.column("v").slice(start, OBJECT_ROWS), dimensions), ids[start : start + OBJECT_ROWS]
            for n, (i, scores) in enumerate(zip(asked.column("vec_id").to_pylist(), q @ x.T)):
                here = [(-s, j) for s, j in zip(scores, who) if j != i]
                tops[n] = heapq.nsmallest(k, tops[n] + here)
        for i, top in zip(asked.column("vec_id").to_pylist(), tops):
            for s, j in top:
                out["query_id"].append(i)
                out["vec_id"].append(j)
                out["score"].append(-s if -(1 << 63) <= -s < 1 << 63 else None)
                out["key"].append(sortable(-s))
        return pa.table({c: pa.array(values, pa.binary() if c == "key" else pa.int64()) for c, values in out.items()})

    pairs = dealt(queries, "block", n_blocks, "slice", n_slices).cogroup(dealt(candidates, "slice", n_slices, "block", n_blocks))
    return pairs.applyInArrow(search, kind)


def top_k(rows, is_query, k=20, scale=64):
    """For each row of ``rows`` (vec_id, vector) with ``is_query``, its k highest inner products with the others.

    Returns query_id, rank (from 1), vec_id and score.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    plain = F.col("square") < MOST_SQUARE
    all_vectors, seen = scratch.put(
        whole_vectors(rows, scale), "vectors", dimensions=F.max(F.size("v")), square=F.max(F.when(plain, F.col("square"))),
        queries=F.count_if(is_query), wide=F.count_if(~plain),
    )
    vectors = all_vectors.where(plain).select("vec_id", F.transform("v", lambda c: c.cast("int")).alias("v"))
    n_blocks, n_slices = -(-seen["queries"] // QUERY_BLOCK) or 1, -(-seen["rows"] // SLICE_ROWS) or 1
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    empty = PivotTable(np.zeros((0, seen["dimensions"])), seen["square"], seen["dimensions"])
    pivots = choose_pivots(empty.matrix(picked.column("v").combine_chunks()), PIVOTS) if picked.num_rows else empty.pivots
    # At most PIVOTS vectors.
    shared = spark.sparkContext.broadcast(PivotTable(pivots, seen["square"], seen["dimensions"]))

    def pack(batches):
        table = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(start, PACK_ROWS)
                x = table.matrix(part.column("v"))
                ids = part.column("vec_id").to_numpy().astype(np.int64)
                packed = [[x.tobytes()], [ids.tobytes()], [table.of_candidates(x).tobytes()], [int(ids[0])]]
                yield pa.record_batch(packed, names=["x", "ids", "distances", "first"])

    def blocks(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    packed = vectors.mapInArrow(pack, "x binary, ids binary, distances binary, first long")
    packed = packed.select("x", "ids", "distances", F.pmod(F.xxhash64("first"), F.lit(n_slices)).cast("int").alias("slice"), blocks(n_blocks).alias("block"))
    queries = vectors.where(is_query).select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), blocks(n_slices).alias("slice"))

    wide = seen["wide"] > 0

    def search(key, asked, held):
        table = shared.value
        found = []
        if asked.num_rows and held.num_rows:
            x = np.concatenate([np.frombuffer(b, dtype=np.int32) for b in held.column("x").to_pylist()]).reshape(-1, table.dimensions)
            ids = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in held.column("ids").to_pylist()])
            to_pivots = np.concatenate([np.frombuffer(b, dtype=np.float32) for b in held.column("distances").to_pylist()]).reshape(len(ids), len(table.pivots))
            to_pivots, x = np.ascontiguousarray(to_pivots.T), table.exact(x)
            q = table.matrix(asked.column("v").combine_chunks())
            asked_ids, of_query = asked.column("vec_id").to_numpy(), table.of_queries(q)
            q = table.exact(q)
            found = [(i, *table.search(q[n], i, of_query[n], x, ids, to_pivots, k)) for n, i in enumerate(asked_ids)]
        sizes = [len(s) for _, s, _ in found]
        return pa.table(
            {
                "query_id": pa.array(np.repeat(np.array([i for i, _, _ in found], dtype=np.int64), sizes)),
                "vec_id": pa.array(np.concatenate([w for _, _, w in found]) if found else np.zeros(0, dtype=np.int64)),
                "score": pa.array(scores := np.concatenate([s for _, s, _ in found]) if found else np.zeros(0, dtype=np.int64)),
                "key": pa.array([sortable(s) for s in scores.tolist()] if wide else [None] * len(scores), pa.binary()),
            }
        )

    pairs = queries.groupBy("block", "slice").cogroup(packed.groupBy("block", "slice"))
    kind = "query_id long, vec_id long, score long, key binary"
    best = pairs.applyInArrow(search, kind)
    if wide:
        # Read once more, as a cogroup needs two frames of different columns.
        again = scratch.get("vectors", all_vectors.schema)
        best = best.unionByName(wide_pairs(all_vectors.where(is_query), again.where(~plain), seen, k, kind))
        best = best.unionByName(wide_pairs(all_vectors.where(~plain).where(is_query), again.where(plain), seen, k, kind))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
