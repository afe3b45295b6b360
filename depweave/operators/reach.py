"""Reachability along dependencies, and cycle probes built on it."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.operators.order import levels
from depweave.plans import kernels
from depweave.plans.limits import limit
from depweave.plans.mergelog import Buckets, MergeLog
from depweave.plans.packs import Tiers
from depweave.plans.scratch import Scratch
from depweave.plans.skew import running_totals
from depweave.schemas import BOOL, LONG

REACHED = T.StructType([T.StructField(c, LONG, True) for c in ("graph_id", "seed_id", "task_id", "hops")])
PROBE = ["graph_id", "dependent_id", "dependency_id"]
PROBED = T.StructType([T.StructField(c, LONG, True) for c in PROBE] + [T.StructField("would_cycle", BOOL, True)])


def _search_sizes(edges, searches):
    """Rows per graph that its searches may touch: every search can meet every edge once."""
    ones = edges.select("graph_id", F.lit(1).alias("e"), F.lit(0).alias("s"))
    return (
        ones.unionAll(searches.select("graph_id", F.lit(0), F.lit(1)))
        .groupBy("graph_id")
        .agg((F.sum("s") + 1.0).alias("s"), (F.sum("e") + 1.0).alias("e"))
        .select("graph_id", F.least(F.col("s") * F.col("e"), F.lit(1e18)).cast("long").alias("weight"))
    )


def endpoints(edges):
    """Every task that takes part in an edge."""
    both = F.explode(F.array("dependent_id", "dependency_id")).alias("task_id")
    return edges.select("graph_id", both).distinct()


def reachable(edges, seeds, direction="up", max_hops=None, plan=None):
    """Every task reached from each seed, with the smallest number of hops.

    ``up`` follows dependencies, ``down`` follows dependents. A seed reaches itself in 0 hops.
    Only the edges of graphs with a seed are looked at; rows with a NULL take no part.
    ``plan="rounds"`` sends graphs of any size through the rounds meant for large ones.
    """
    source, target = {"up": ("dependent_id", "dependency_id"), "down": ("dependency_id", "dependent_id")}[direction]
    edges = edges.select("graph_id", F.col(source).alias("source"), F.col(target).alias("target")).dropna()
    seeds = seeds.select("graph_id", F.col("task_id").alias("seed_id")).dropna().distinct()
    edges = edges.join(seeds.select("graph_id").distinct(), "graph_id", "left_semi")
    tiers = Tiers(_search_sizes(edges, seeds), plan=plan)

    def kernel(seeds, edges):
        nodes, links, starts = _search_space(edges, seeds["graph_id"], seeds["seed_id"])
        offsets, spans = _graph_spans(nodes[0], starts)
        search, node, hops = kernels.spread(links, starts, spans, offsets, max_hops=max_hops)
        return {
            "graph_id": seeds["graph_id"][search],
            "seed_id": seeds["seed_id"][search],
            "task_id": nodes[1][node],
            "hops": hops.astype(np.int64),
        }

    if not tiers.any_large:
        return tiers.run(kernel, REACHED, seeds, edges)
    found = tiers.run(kernel, REACHED, tiers.small(seeds), tiers.small(edges))
    large = _reach_by_rounds(tiers.large(edges), tiers.large(seeds), max_hops)
    return found.unionByName(large) if tiers.any_small else large


def _search_space(edges, start_graphs, start_ids):
    graphs, ids = kernels.nodes_of(
        np.concatenate([edges["graph_id"], edges["graph_id"], start_graphs]),
        np.concatenate([edges["source"], edges["target"], start_ids]),
    )
    find = kernels.finder(graphs, ids)
    links = kernels.Links(len(ids), find(edges["graph_id"], edges["source"]), find(edges["graph_id"], edges["target"]))
    return (graphs, ids), links, find(start_graphs, start_ids)


def _graph_spans(graphs, starts):
    first = np.searchsorted(graphs, graphs[starts], side="left")
    return first, np.searchsorted(graphs, graphs[starts], side="right") - first


def _reach_by_rounds(edges, seeds, max_hops):
    """All searches move one hop per round, 64 searches of a graph to a row.

    A row (node, block, mask) says which of the 64 searches of a block come to a node, so searches that
    overlap travel and are stored as bits of one LONG. Nodes and the edges from them lie in the same hash buckets.
    A hop reads the edges of its wave's buckets, and of what was visited only the buckets it steps into. What
    was visited is a `MergeLog`: it is merged a few runs at a time, never as a whole for a hop.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    edges, n_edges = scratch.put(edges, "edges")
    links = Buckets(edges, ["graph_id", "source"], n_edges["rows"], scratch, "links")
    place, node = ["_bucket", "graph_id", "node", "block"], ["graph_id", "node"]
    ranked = running_totals(seeds, ["graph_id"], ["seed_id"], rank=F.lit(1)).select(
        "graph_id", "seed_id", F.expr("(rank - 1) div 64 AS block"), F.expr("shiftleft(1L, CAST((rank - 1) % 64 AS INT)) AS bit")
    )
    ranked = scratch.put(ranked, "seeds")[0]
    visited = MergeLog(scratch, "visited", place, [F.bit_or("mask").alias("mask")], "true", sort_by=["_bucket"])

    def written(rows, name):
        rows = rows.withColumn("_bucket", links.of(*node)).select(*place, "mask")
        # Sorted by bucket, so that a read skips what it does not name; a folder per bucket would be many tiny files.
        rows = rows.hint("rebalance", "_bucket").sortWithinPartitions("_bucket") if links.n > 1 else rows
        return scratch.put(rows, name, **links.masks(F.lit(True), *node))

    wave, seen = written(ranked.select("graph_id", F.col("seed_id").alias("node"), "block", F.col("bit").alias("mask")), "met/hops=0")
    schema, hops = T.StructType([*wave.schema.fields, T.StructField("hops", LONG, True)]), 0
    while seen["rows"] and hops != max_hops:
        visited.add(wave, seen["rows"])
        step = (
            wave.drop("_bucket")
            .withColumnRenamed("node", "source")
            .join(links.read(seen), links.keys)
            .groupBy("graph_id", F.col("target").alias("node"), "block")
            .agg(F.bit_or("mask").alias("mask"))
        )
        old = visited.rows()
        if links.n > 1:
            # Written first: it tells which buckets of the visited rows it meets.
            step, met = written(step, f"step-{hops}")
            old = old.where(F.col("_bucket").isin(links.named(met)))
            step = step.drop("_bucket")
        old = old.groupBy(*node, "block").agg(F.bit_or("mask").alias("old"))
        fresh = step.join(old, [*node, "block"], "left").withColumn("mask", F.expr("mask & ~coalesce(old, 0L)"))
        hops += 1
        wave, seen = written(fresh.where("mask <> 0"), f"met/hops={hops}")
        if links.n > 1:
            scratch.drop(f"step-{hops - 1}")
    met = scratch.get("met", schema).drop("_bucket")
    return (
        met.join(ranked, ["graph_id", "block"])
        .where("mask & bit <> 0")
        .select("graph_id", "seed_id", F.col("node").alias("task_id"), "hops")
    )


def probe_cycles(edges, cand, plan=None):
    """Whether each candidate, added alone to the present graph, would close a cycle.

    That is so if the dependent is among the direct or indirect dependencies of the
    dependency. Candidates with the same dependency share one search. On a search path levels
    only fall, so nothing below the lowest dependent sought is entered; tasks without a level
    (behind a cycle) always are. A candidate with a NULL closes no cycle, and only the edges of
    graphs with a candidate are looked at. ``plan="rounds"`` sends graphs of any size through the
    rounds meant for large ones.
    """
    edges = edges.select("graph_id", F.col("dependent_id").alias("source"), F.col("dependency_id").alias("target")).dropna()
    probes = cand.select(*PROBE).dropna().distinct()
    edges = edges.join(probes.select("graph_id").distinct(), "graph_id", "left_semi")
    tiers = Tiers(_search_sizes(edges, probes.select("graph_id", "dependency_id").distinct()), plan=plan)
    probed = None
    if tiers.any_small:
        probed = tiers.run(_probe_pack, PROBED, tiers.small(probes), tiers.small(edges))
    if tiers.any_large:
        large = _probe_by_rounds(tiers.large(edges), tiers.large(probes))
        probed = large if probed is None else probed.unionByName(large)
    if probed is None:
        return cand.withColumn("would_cycle", F.lit(False))
    return cand.join(probed, PROBE, "left").select(
        *cand.columns, F.coalesce("would_cycle", F.lit(False)).alias("would_cycle")
    )


def _probe_pack(probes, edges):
    (graphs, ids), links, ends = _search_space(
        edges,
        np.concatenate([probes["graph_id"]] * 2),
        np.concatenate([probes["dependency_id"], probes["dependent_id"]]),
    )
    sources, goals = np.split(ends, 2)
    starts, search_of = np.unique(sources, return_inverse=True)
    waits_for = np.repeat(np.arange(len(ids)), np.diff(links.first))
    waiting = np.bincount(waits_for, minlength=len(ids))
    level, _ = kernels.release(
        kernels.Links(len(ids), links.target, waits_for), np.flatnonzero(waiting == 0), waiting
    )
    floor = np.full(len(starts), np.iinfo(np.int64).max)
    np.minimum.at(floor, search_of, level[goals])  # -1, below all levels, where a goal has none

    def allowed(search, node):
        return (level[node] < 0) | (level[node] >= floor[search])

    offsets, spans = _graph_spans(graphs, starts)
    search, node, _ = kernels.spread(links, starts, spans, offsets, allowed)
    met = search * len(ids) + node
    return {**probes, "would_cycle": np.isin(search_of * len(ids) + goals, met)}


def _probe_by_rounds(edges, probes):
    """All searches move one hop per round, 64 searches to a row.

    A row (block, node, mask) says which of the 64 searches of a block are at a node, so
    overlapping searches travel, meet and are stored as bits of one LONG. Searches are put
    into blocks by the level they may stop at, which keeps the pruning of a block sharp. The bit of a
    search is cleared as soon as all its probes are met, and the rounds end with the last open probe.
    """
    scratch = Scratch(edges.sparkSession, "probe")
    edges = scratch.put(edges, "edges")[0]
    graph = edges.select("graph_id", F.col("source").alias("dependent_id"), F.col("target").alias("dependency_id"))
    level_of = scratch.put(levels(endpoints(graph), graph), "levels")[0]
    goal = level_of.select("graph_id", F.col("task_id").alias("dependent_id"), F.col("level").alias("goal_level"))
    start_key = ["graph_id", "dependency_id"]
    starts = (
        probes.join(goal, ["graph_id", "dependent_id"], "left")
        .groupBy(*start_key)
        .agg(F.min(F.coalesce("goal_level", F.lit(-1))).alias("floor"))
    )
    starts = scratch.put(starts, "starts")[0]
    starts = running_totals(starts, ["graph_id"], ["floor", "dependency_id"], rank=F.lit(1)).select(
        *start_key, "floor", F.expr("(rank - 1) div 64 AS block"), F.expr("shiftleft(1L, CAST((rank - 1) % 64 AS INT)) AS mask")
    )
    starts = scratch.put(starts, "blocks")[0]
    floors = starts.groupBy("graph_id", "block").agg(F.min("floor").alias("floor"))
    target_level = level_of.select("graph_id", F.col("task_id").alias("target"), F.col("level").alias("target_level"))
    edges = scratch.put(edges.join(target_level, ["graph_id", "target"], "left"), "levelled")[0]
    place = ["graph_id", "block", "node"]
    start = starts.drop("floor").join(floors, ["graph_id", "block"]).withColumnRenamed("dependency_id", "node")
    search = ["graph_id", "block", "mask"]
    sought = probes.join(starts.drop("floor"), start_key).withColumn("node", F.col("dependent_id"))
    asked = sought.groupBy(*search).agg(F.count(F.lit(1)).alias("asked"))
    # A probe knows how many its search has, so answers alone tell when a search may retire.
    sought, left = scratch.put(sought.join(asked, search), "sought")
    open_probes = left["rows"]
    wave, seen = scratch.put(start.select(*place, "floor", "mask"), "met/hop=0")
    schema, hop = T.StructType([*wave.schema.fields, T.StructField("hop", LONG, True)]), 0
    answered = T.StructType([*sought.schema.fields, T.StructField("hop", LONG, True)])
    most = limit(edges.sparkSession, "broadcastRows")
    while seen["rows"]:
        # Answers of this hop; a task is met once by a search, so a probe is answered once.
        at = sized(wave.select(*place, F.col("mask").alias("at")), seen["rows"], most)
        _, found = scratch.put(sought.join(at, place).where("mask & at <> 0").drop("at"), f"answered/hop={hop}")
        open_probes -= found["rows"]
        if not open_probes:
            break
        done = scratch.get("answered", answered).groupBy(*search).agg(F.max("asked").alias("asked"), F.count(F.lit(1)).alias("n"))
        done = done.where("n = asked").groupBy("graph_id", "block").agg(F.bit_or("mask").alias("done"))
        live = wave.join(done, ["graph_id", "block"], "left").withColumn("mask", F.expr("mask & ~coalesce(done, 0L)")).where("mask <> 0").drop("done")
        met = scratch.get("met", schema)
        if seen["rows"] <= most:
            # What was met elsewhere is not shuffled for a small wave.
            met = met.join(F.broadcast(wave.select("graph_id", "block").distinct()), ["graph_id", "block"], "left_semi")
        met = met.groupBy(*place).agg(F.bit_or("mask").alias("old"))
        step = (
            edges.join(sized(live.withColumnRenamed("node", "source"), seen["rows"], most), ["graph_id", "source"])
            .where(F.coalesce(F.col("target_level") >= F.col("floor"), F.lit(True)))
            .groupBy("graph_id", "block", F.col("target").alias("node"))
            .agg(F.min("floor").alias("floor"), F.bit_or("mask").alias("new"))
            .join(met, place, "left")
            .select(*place, "floor", F.expr("new & ~coalesce(old, 0L) AS mask"))
            .where("mask <> 0")
        )
        hop += 1
        wave, seen = scratch.put(step, f"met/hop={hop}")
    found = scratch.get("answered", answered).select(*PROBE, F.lit(True).alias("found"))
    return probes.join(found, PROBE, "left").select(*PROBE, F.coalesce("found", F.lit(False)).alias("would_cycle"))


def sized(rows, n, most):
    """A broadcast of ``rows`` where the counted ``n`` allows it."""
    return F.broadcast(rows) if n <= most else rows
