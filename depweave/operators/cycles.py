"""Cyclic parts of graphs, and the exact admission of edges offered one after the other."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.operators.edges import OFFER, as_edges, classify_edges
from depweave.operators.order import levels
from depweave.operators.reach import endpoints
from depweave.plans import kernels
from depweave.plans.packs import PACK, Tiers, graph_sizes, packed
from depweave.plans.scratch import Scratch
from depweave.plans.skew import running_totals
from depweave.schemas import BOOL, LONG

KNOT = T.StructType(
    [
        T.StructField("graph_id", LONG, True),
        T.StructField("task_id", LONG, True),
        T.StructField("stuck", BOOL, True),
        T.StructField("core", BOOL, True),
        T.StructField("scc_id", LONG, True),
        T.StructField("in_cycle", BOOL, True),
    ]
)
# Offers of one component that are decided at a time when the component is beyond one task.
BATCH_OFFERS = 1024
# Rows of a pack, in whole graphs, that are decided together.
TOGETHER = 20_000
DECIDED = T.StructType(
    [
        T.StructField("graph_id", LONG, True),
        T.StructField("edge_seq", LONG, True),
        T.StructField("accepted", BOOL, True),
    ]
)


def cyclic_core(tasks, edges, plan=None):
    """Tasks a run never reaches (``stuck``), and those also left when leaves are removed
    from these again and again (``core``: the tasks on cycles or between cycles).

    A task listed twice counts once, and rows with a NULL graph or task are none.
    ``plan="rounds"`` sends graphs of any size through the rounds meant for large ones."""
    return _knots(tasks, edges, plan).select("graph_id", "task_id", "stuck", "core")


def cycle_members(tasks, edges, plan=None):
    """Strongly connected component of every task, named by its smallest task id.

    Rows and ``plan`` as in `cyclic_core`.
    """
    return _knots(tasks, edges, plan).select("graph_id", "task_id", "scc_id", "in_cycle")


def _knots(tasks, edges, plan):
    tasks = tasks.select("graph_id", "task_id").dropna()
    edges = edges.select("graph_id", "dependent_id", "dependency_id").dropna()
    tiers = Tiers(graph_sizes(tasks, edges), plan=plan)
    small = tiers.run(_knot_pack, KNOT, tiers.small(tasks), tiers.small(edges))
    if not tiers.any_large:
        return small
    large = _knots_by_rounds(tiers.large(tasks).distinct(), tiers.large(edges))
    return small.unionByName(large) if tiers.any_small else large


def _knot_pack(tasks, edges):
    graphs, ids = kernels.nodes_of(tasks["graph_id"], tasks["task_id"])
    tasks = {"graph_id": graphs, "task_id": ids}
    n = len(tasks["task_id"])
    find = kernels.finder(tasks["graph_id"], tasks["task_id"])
    dependent, dependency = find(edges["graph_id"], edges["dependent_id"]), find(edges["graph_id"], edges["dependency_id"])
    waiting = np.bincount(dependent[dependent >= 0], minlength=n)
    known = (dependent >= 0) & (dependency >= 0)
    dependent, dependency = dependent[known], dependency[known]
    level, _ = kernels.release(kernels.Links(n, dependency, dependent), np.flatnonzero(waiting == 0), waiting)
    stuck = level < 0
    inside = stuck[dependent] & stuck[dependency]
    core = stuck & kernels.peel(n, dependent[inside], dependency[inside])
    inside = core[dependent] & core[dependency]
    component = kernels.components(n, dependency[inside], dependent[inside])
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, component, tasks["task_id"])
    return {
        **tasks,
        "stuck": stuck,
        "core": core,
        "scc_id": smallest[component],
        "in_cycle": np.bincount(component, minlength=n)[component] > 1,
    }


def _knots_by_rounds(tasks, edges):
    """Peel from both ends, then label what is left."""
    scratch = Scratch(tasks.sparkSession, "knots")
    edges = scratch.put(edges, "edges")[0]
    stuck = scratch.put(levels(tasks, edges), "forward")[0]
    caught = stuck.where("level IS NULL").select("graph_id", "task_id")
    inner = scratch.put(_between(edges, caught), "stuck-edges")[0]
    turned = inner.select(
        "graph_id", F.col("dependent_id").alias("dependency_id"), F.col("dependency_id").alias("dependent_id")
    )
    back = scratch.put(levels(caught, turned), "backward")[0]
    core = back.where("level IS NULL").select("graph_id", "task_id")
    labels = _labels_by_rounds(core, _between(inner, core), scratch)
    cyclic = labels.groupBy("graph_id", "scc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    labels = labels.join(cyclic.withColumn("in_cycle", F.lit(True)), ["graph_id", "scc_id"], "left")
    backward = back.select("graph_id", "task_id", F.col("level").isNull().alias("core"))
    return (
        stuck.join(backward, ["graph_id", "task_id"], "left")
        .join(labels, ["graph_id", "task_id"], "left")
        .select(
            "graph_id",
            "task_id",
            F.col("level").isNull().alias("stuck"),
            F.coalesce("core", F.lit(False)).alias("core"),
            F.coalesce("scc_id", "task_id").alias("scc_id"),
            F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        )
    )


def _between(edges, tasks):
    """The edges with both ends among ``tasks``."""
    for end in ("dependent_id", "dependency_id"):
        edges = edges.join(tasks.withColumnRenamed("task_id", end), ["graph_id", end], "left_semi")
    return edges


def _labels_by_rounds(tasks, edges, scratch):
    """Component labels of large graphs.

    Every task takes the smallest label that reaches it; labels are hashes of the ids, drawn anew in
    every turn. Within such a colour the owner has the smallest label of all, so the tasks that also
    reach the owner are those whose smallest label backwards is the owner's again: they form its
    component. They are removed, links between colours fall away, what no longer has links on both sides is trimmed, and the
    rest is labelled again; graphs that have become small enough are finished in packs. As
    labels are random, the colours of a long row of components halve in a turn, whatever their ids.
    """
    done, turn = [], 0
    while True:
        tasks, n = scratch.put(tasks, f"rest-{turn}")
        edges = scratch.put(edges, f"rest-edges-{turn}")[0]
        if not n["rows"]:
            break
        tiers = Tiers(graph_sizes(tasks, edges))
        if tiers.any_small:
            packs = tiers.run(_knot_pack, KNOT, tiers.small(tasks), tiers.small(edges))
            done.append(packs.select("graph_id", "task_id", "scc_id"))
        if not tiers.any_large:
            break
        tasks, edges = tiers.large(tasks), tiers.large(edges)
        label = F.struct(F.xxhash64(F.lit(turn), "graph_id", "task_id").alias("draw"), F.col("task_id").alias("id")).alias("label")
        named = tasks.select("graph_id", "task_id", label)
        reach = _smallest_reaching(named, edges, "dependency_id", "dependent_id", scratch, f"from-{turn}")
        coloured = edges
        for end, name in (("dependent_id", "_c1"), ("dependency_id", "_c2")):
            coloured = coloured.join(reach.toDF("graph_id", end, name), ["graph_id", end])
        coloured = scratch.put(coloured.where("_c1 = _c2").drop("_c1", "_c2"), f"coloured-{turn}")[0]
        back = _smallest_reaching(named, coloured, "dependent_id", "dependency_id", scratch, f"to-{turn}")
        both = reach.join(back.withColumnRenamed("label", "owner"), ["graph_id", "task_id"])
        both = scratch.put(both, f"both-{turn}")[0]
        found = both.where("label = owner").select("graph_id", "task_id", F.col("label.id").alias("owner"))
        smallest = found.groupBy("graph_id", "owner").agg(F.min("task_id").alias("scc_id"))
        done.append(found.join(smallest, ["graph_id", "owner"]).select("graph_id", "task_id", "scc_id"))
        tasks = both.where("label <> owner").select("graph_id", "task_id")
        tasks, edges = _trimmed(tasks, _between(coloured, tasks), scratch, f"trim-{turn}")
        turn += 1
    if not done:
        return tasks.withColumn("scc_id", F.col("task_id"))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return scratch.put(result, "labels")[0]


def _trimmed(tasks, edges, scratch, name):
    """Tasks with links on both sides and the links between them, taken off while that removes an eighth of them.

    What is trimmed is a component of its own, as is every task without a label.
    """
    edges, seen = scratch.put(edges, f"{name}-0")
    rows, turn = seen["rows"], 0
    while rows:
        starts = edges.select("graph_id", F.col("dependency_id").alias("task_id"))
        ends = edges.select("graph_id", F.col("dependent_id").alias("task_id"))
        tasks = tasks.join(starts, ["graph_id", "task_id"], "left_semi").join(ends, ["graph_id", "task_id"], "left_semi")
        turn += 1
        edges, seen = scratch.put(_between(edges, tasks), f"{name}-{turn}")
        if seen["rows"] * 8 > rows * 7:
            break
        rows = seen["rows"]
    return (tasks, edges) if rows else (tasks.where(F.lit(False)), edges)


def _smallest_reaching(labels, edges, source, target, scratch, name):
    """Smallest label that reaches each task along source -> target, its own included.

    Each round takes the labels of direct neighbours and then the label of the label's own
    task, which also reaches this task; the second step doubles the distance covered.
    """
    key = ["graph_id", "task_id"]
    labels = scratch.put(labels.select(*key, "label"), f"{name}-0")[0]
    turn, changed = 0, 1
    while changed:
        sent = labels.withColumnRenamed("task_id", source).join(edges, ["graph_id", source])
        offered = sent.groupBy("graph_id", F.col(target).alias("task_id")).agg(F.min("label").alias("offered"))
        near = labels.join(offered, key, "left").select(*key, "label", F.least("label", "offered").alias("near"))
        jump = labels.select("graph_id", F.col("task_id").alias("_at"), F.col("label").alias("far"))
        near = near.withColumn("_at", F.col("near.id"))
        moved = near.join(jump, ["graph_id", "_at"], "left").select(
            *key, F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")
        )
        written, seen = scratch.put(moved, f"{name}-{turn + 1}", moved=F.count_if("moved"))
        scratch.drop(f"{name}-{turn}")
        labels, changed, turn = written.drop("moved"), seen["moved"], turn + 1
    return labels


def admit_edges(cand, tasks, graphs=None, plan=None, batch=BATCH_OFFERS):
    """The verdict of every offer when offers are taken one after the other in ``seq`` order.

    An offer is refused as ``cycle`` if it would close a cycle with the edges accepted so
    far, and as ``duplicate`` if the same edge was accepted before. Offering a refused edge
    again gives ``cycle`` again, because accepted edges are never taken back.

    Offers of one ``seq`` are taken by dependent, then dependency, and a missing ``seq`` comes first. Rows
    equal in ``seq`` and edge are one offer. ``plan="rounds"`` sends components of any size through what is meant
    for those beyond one task, which decides ``batch`` offers of a component at a time.
    """
    scratch = Scratch(cand.sparkSession, "admit")
    judged = scratch.put(classify_edges(cand, tasks, graphs), "classified")[0]
    offers, seen = scratch.put(as_edges(judged.where("verdict = 'ok'")).distinct(), "offers")
    order = ["edge_seq", "dependent_id", "dependency_id"]
    offers = running_totals(offers, ["graph_id"], order, known_rows=seen["rows"], place=F.lit(1))
    # From here on edge_seq is the place in the total order.
    offers = scratch.put(offers.withColumn("edge_seq", F.col("place")).drop("place"), "ordered")[0]
    decided = _admit(offers.withColumn("fixed", F.lit(False)), scratch, "a", plan, batch)
    refused = offers.join(decided.where("NOT accepted"), ["graph_id", "edge_seq"], "left_semi")
    refused = refused.select(
        F.col("graph_id").alias("dependent_graph_id"), "dependent_id", F.col("graph_id").alias("dependency_graph_id"), "dependency_id"
    )
    refused = scratch.put(refused.withColumn("_refused", F.lit(True)), "refused")[0]
    structural = ~F.col("verdict").isin("ok", "repeat")
    verdict = (
        F.when(structural, F.col("verdict"))
        .when(F.col("_refused"), "cycle")
        .when(F.col("verdict") == "repeat", "duplicate")
        .otherwise("ok")
    )
    return (
        judged.join(refused, OFFER, "left")
        .withColumn("verdict", verdict)
        .select(*cand.columns, "verdict", (F.col("verdict") == "ok").alias("accepted"))
    )


def _admit(rows, scratch, name, plan, batch):
    """Decide the offers among ``rows``; rows marked ``fixed`` are accepted already.

    Graphs that fit one task are decided there. In larger graphs a cycle lies inside one
    strongly connected component of all rows, so edges between components are accepted and
    components are decided apart. A component too large for one task is halved by ``edge_seq``
    while it has more than ``batch`` offers: the first half is decided, what it accepted becomes fixed, then
    the second half follows. ``batch`` offers are decided on what their ends reach along fixed edges.
    """
    columns = ["graph_id", "edge_seq", "dependent_id", "dependency_id", "fixed"]
    rows = scratch.put(rows.select(*columns), f"{name}-rows")[0]
    tiers = Tiers(graph_sizes(rows), limit_name="admitRows", plan=plan)
    decided = [_admit_packs(tiers, rows)]
    if tiers.any_large:
        large = tiers.large(rows)
        members = cycle_members(endpoints(large), large)
        members = scratch.put(members.where("in_cycle").select("graph_id", "task_id", "scc_id"), f"{name}-members")[0]
        placed = large
        for end, label in (("dependent_id", "_s1"), ("dependency_id", "_s2")):
            placed = placed.join(members.toDF("graph_id", end, label), ["graph_id", end], "left")
        placed = placed.select(*columns, F.when(F.col("_s1") == F.col("_s2"), F.col("_s1")).alias("scc_id"))
        placed = scratch.put(placed, f"{name}-placed")[0]
        free = placed.where("scc_id IS NULL AND NOT fixed")
        decided.append(free.select("graph_id", "edge_seq", F.lit(True).alias("accepted")))
        knotted = placed.where("scc_id IS NOT NULL")
        component = ["graph_id", "scc_id"]
        sizes = knotted.groupBy(*component).agg(F.count(F.lit(1)).alias("weight"))
        parts = Tiers(sizes, component, "admitRows", plan)
        decided.append(_admit_packs(parts, knotted))
        if parts.any_large:
            decided += _admit_large(parts.large(knotted), component, scratch, name, plan, batch)
    result = decided[0]
    for part in decided[1:]:
        result = result.unionByName(part)
    return scratch.put(result, f"{name}-decided")[0]


def _admit_large(rows, component, scratch, name, plan, batch):
    """Decide batches on the closure of their ends, and halve components with more offers."""
    offers = rows.where("NOT fixed").groupBy(*component).agg(
        F.percentile_approx("edge_seq", 0.5).alias("_middle"), F.count(F.lit(1)).alias("_offers")
    )
    rows, seen = scratch.put(rows.join(offers, component), f"{name}-halves", more=F.count_if(F.col("_offers") > batch))
    last = _admit_batch(rows.where(F.col("_offers") <= batch), component, scratch, name)
    if not seen["more"]:
        return [last]
    rows = rows.where(F.col("_offers") > batch)
    first = _admit(rows.where("fixed OR edge_seq <= _middle"), scratch, name + "1", plan, batch)
    kept = first.where("accepted").select("graph_id", "edge_seq", F.lit(True).alias("_kept"))
    later = (
        rows.join(kept, ["graph_id", "edge_seq"], "left")
        .where("fixed OR edge_seq > _middle OR _kept")
        .withColumn("fixed", F.col("fixed") | F.coalesce("_kept", F.lit(False)))
    )
    return [last, first, _admit(later, scratch, name + "2", plan, batch)]


def _admit_batch(rows, component, scratch, name):
    """Decide all offers of components with a bounded number of them, however many fixed edges these have.

    The dependency ends of the offers are searches that move along fixed edges, as bits of
    masks; only the masks at dependent ends are kept. They say which offer alone would close a cycle, and a
    task per component follows the offers in order, joining what an accepted one connects.
    """
    rows = scratch.put(rows, f"{name}-batch")[0]
    offers, fixed = rows.where("NOT fixed"), rows.where("fixed")
    starts = offers.select(*component, F.col("dependency_id").alias("node")).distinct()
    starts = running_totals(starts, component, ["node"], search=F.lit(1)).withColumn("search", F.col("search") - 1)
    starts = scratch.put(starts, f"{name}-searches")[0]
    wave = starts.select(*component, "node", F.expr("search div 64 AS word"), F.expr("shiftleft(1L, CAST(search % 64 AS INT)) AS mask"))
    place = [*component, "word", "node"]
    folder = f"{name}-reached"
    wave, seen = scratch.put(wave, f"{folder}/hop=0")
    schema, hop = T.StructType([*wave.schema.fields, T.StructField("hop", LONG, True)]), 0
    links = fixed.select(*component, F.col("dependent_id").alias("source"), F.col("dependency_id").alias("target"))
    while seen["rows"]:
        old = scratch.get(folder, schema).groupBy(*place).agg(F.bit_or("mask").alias("old"))
        step = wave.withColumnRenamed("node", "source").join(links, [*component, "source"])
        step = step.groupBy(*component, "word", F.col("target").alias("node")).agg(F.bit_or("mask").alias("new"))
        step = step.join(old, place, "left").select(*component, "node", "word", F.expr("new & ~coalesce(old, 0L) AS mask"))
        hop += 1
        wave, seen = scratch.put(step.where("mask <> 0"), f"{folder}/hop={hop}")
    ends = offers.select(*component, F.col("dependent_id").alias("node")).distinct()
    met = scratch.get(folder, schema).join(ends, [*component, "node"], "left_semi").groupBy(*place).agg(F.bit_or("mask").alias("mask"))
    numbered = offers.join(starts.withColumnRenamed("node", "dependency_id"), [*component, "dependency_id"])
    group = F.struct(*component)
    numbered = numbered.select("graph_id", "edge_seq", "dependent_id", "search", group.alias(PACK))
    return packed(_follow_batch, DECIDED, None, numbered, met.select("node", "word", "mask", group.alias(PACK)))


def _follow_batch(offers, met):
    """Offers in order; ``reaching`` has per dependent end the searches that arrive there."""
    reaching = dict.fromkeys(offers["dependent_id"].tolist(), 0)
    for node, word, mask in zip(met["node"].tolist(), met["word"].tolist(), met["mask"].tolist()):
        reaching[node] |= (mask & 0xFFFFFFFFFFFFFFFF) << (64 * word)
    order = np.argsort(offers["edge_seq"], kind="stable")
    accepted = np.ones(len(order), dtype=bool)
    for i in order.tolist():
        end, start = int(offers["dependent_id"][i]), 1 << int(offers["search"][i])
        into = reaching[end]
        if into & start:
            accepted[i] = False
        elif into:
            # What arrives at the dependent now goes on to wherever the dependency leads.
            for node, searches in reaching.items():
                if searches & start:
                    reaching[node] = searches | into
    return {"graph_id": offers["graph_id"], "edge_seq": offers["edge_seq"], "accepted": accepted}


def _admit_packs(tiers, rows):
    """Decide the groups that fit one task, a pack at a time."""
    return tiers.run(_admit_pack, DECIDED, tiers.small(rows))


def _admit_pack(rows):
    """Graphs of a pack do not meet, so a few are decided at a time: their neighbour sets are by far the largest part of the memory."""
    offered = np.lexsort((rows["edge_seq"], rows["graph_id"]))
    rows = {name: values[offered] for name, values in rows.items()}
    fixed = rows["fixed"].astype(bool)
    accepted = np.ones(len(fixed), dtype=bool)
    begins = np.flatnonzero(np.diff(rows["graph_id"], prepend=rows["graph_id"][:1] - 1))
    cuts = np.unique(begins[np.searchsorted(begins, np.arange(0, begins[-1] + 1, TOGETHER))]) if len(begins) else begins
    for begin, end in zip(cuts, np.append(cuts[1:], len(fixed))):
        some = {name: values[begin:end] for name, values in rows.items()}
        graphs, ids = kernels.nodes_of(
            np.concatenate([some["graph_id"]] * 2), np.concatenate([some["dependent_id"], some["dependency_id"]])
        )
        find = kernels.finder(graphs, ids)
        accepted[begin:end] = kernels.admit(
            len(ids), find(some["graph_id"], some["dependent_id"]), find(some["graph_id"], some["dependency_id"]), fixed[begin:end]
        )
    return {
        "graph_id": rows["graph_id"][~fixed],
        "edge_seq": rows["edge_seq"][~fixed],
        "accepted": accepted[~fixed],
    }
