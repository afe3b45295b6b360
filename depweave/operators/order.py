"""Levels, the first-in-first-out run order, and what follows from them per graph."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.operators.blocks import levels_by_blocks
from depweave.operators.chains import levels_by_chains
from depweave.operators.edges import degrees
from depweave.operators.identity import task_counts
from depweave.plans import kernels
from depweave.plans.limits import limit
from depweave.plans.packs import PACK, Tiers, graph_sizes, nullable, packed
from depweave.plans.scratch import Scratch
from depweave.plans.skew import previous_value, running_totals
from depweave.schemas import LONG

ORDERED = T.StructType([T.StructField(c, LONG, True) for c in ("graph_id", "task_id", "level", "position")])
# Stands for a missing seq, behind all others.
LAST = (1 << 63) - 1
# A released task's place among the tasks of its level: the place of its last-visited
# dependency in the level before, then the order of the link. Roots go by insertion order.
PLACED = T.StructType(
    [T.StructField(c, LONG, True) for c in ("graph_id", "task_id", "level", "place", "link")]
)


def roots_and_leaves(tasks, edges):
    """Tasks without dependencies are roots, tasks without dependents are leaves."""
    return degrees(tasks, edges).select(
        "graph_id",
        "task_id",
        (F.col("n_dependencies") == 0).alias("is_root"),
        (F.col("n_dependents") == 0).alias("is_leaf"),
    )


def levels(tasks, edges, plan=None):
    """Longest distance from the roots; NULL for a task that is never released.

    A dependency that is not among the tasks never completes, so its dependents stay NULL.
    ``plan="rounds"`` sends graphs of any size through the rounds meant for large ones, ``plan="chains"``
    through these after contracting chains, as is done by itself for large graphs.
    """
    return _ordered(tasks, edges, False, plan).select("graph_id", "task_id", "level")


def fifo_order(tasks, edges, plan=None):
    """Level and exact run position (from 1) of every task under a first-in-first-out queue.

    Roots queue by ``seq``; a finished task offers its dependents in ``edge_seq`` order.
    """
    return Scratch(tasks.sparkSession, "order").put(_ordered(tasks, edges, True, plan), "ordered")[0]


def validate_graphs(graphs, tasks, edges):
    """Whether each graph can be frozen: it needs a task, a root, and no cycle.

    A graph that ``graphs.finalised`` marks as frozen stays so without another look at it.
    """
    if "finalised" not in graphs.columns:
        return validity_from_levels(graphs, tasks, levels(tasks, edges))
    frozen = graphs.where("finalised").select("graph_id").distinct()
    open_graphs = graphs.select("graph_id").join(frozen, "graph_id", "left_anti")
    tasks, edges = (t.join(frozen, "graph_id", "left_anti") for t in (tasks, edges))
    judged = validity_from_levels(open_graphs, tasks, levels(tasks, edges))
    return judged.unionByName(frozen.select("graph_id", F.lit(True).alias("finalised"), F.lit("ok").alias("reason")))


def validity_from_levels(graphs, tasks, levelled):
    """`validate_graphs` for tasks whose levels are known already."""
    found = levelled.groupBy("graph_id").agg(
        F.count_if(F.col("level") == 0).alias("_roots"),
        F.count_if(F.col("level").isNull()).alias("_stuck"),
    )
    reason = (
        F.when(F.col("task_count") == 0, "empty")
        .when(F.col("_roots") == 0, "no_root")
        .when(F.col("_stuck") > 0, "cycle")
        .otherwise("ok")
    )
    return (
        task_counts(graphs, tasks)
        .join(found, "graph_id", "left")
        .select("graph_id", (reason == "ok").alias("finalised"), reason.alias("reason"))
    )


def _with_default(df, column, default):
    return df if column in df.columns else df.withColumn(column, default.cast("long"))


def _ordered(tasks, edges, ranked, plan=None):
    """Level and position of every task, by packs of small graphs and by rounds for large ones.

    Without ``ranked``, rounds leave the position NULL and spare the ranking. Both plans get the same
    totally ordered input: rows with a NULL graph or task are no tasks or edges, a task
    listed twice counts once with its smallest ``seq``, a NULL ``seq`` or ``edge_seq`` comes last, and equal
    ones go by task id and dependent id.
    """
    tasks = _with_default(tasks, "seq", F.col("task_id")).select("graph_id", "task_id", F.coalesce("seq", F.lit(LAST)).alias("seq"))
    tasks = tasks.where("graph_id IS NOT NULL AND task_id IS NOT NULL")
    edges = _with_default(edges, "edge_seq", F.lit(0))
    edges = edges.select("graph_id", F.coalesce("edge_seq", F.lit(LAST)).alias("edge_seq"), "dependent_id", "dependency_id").dropna()
    tiers = Tiers(graph_sizes(tasks, edges), plan="rounds" if plan == "chains" else plan)
    results = []
    if tiers.any_small:
        results.append(tiers.run(_order_pack, ORDERED, tiers.small(tasks), tiers.small(edges)))
    if tiers.any_large:
        large_tasks, large_edges = tiers.large(tasks), tiers.large(edges)
        if ranked:
            results.append(_rank_placed(_place_by_levels(large_tasks, large_edges)))
        else:
            by = levels_by_blocks if plan == "rounds" else levels_by_chains
            levelled = by(large_tasks.select("graph_id", "task_id").distinct(), large_edges.withColumn("weight", F.lit(1).cast("long")))
            results.append(levelled.withColumn("position", _nothing("position")))
    if not results:
        return tasks.select("graph_id", "task_id", _nothing("level"), _nothing("position"))
    return results[0] if len(results) == 1 else results[0].unionByName(results[1])


def _nothing(name):
    return F.lit(None).cast("long").alias(name)


def _rank_placed(placed):
    placed = Scratch(placed.sparkSession, "placed").put(placed, "placed")[0]
    released = placed.where("level IS NOT NULL")
    ranked = running_totals(released, ["graph_id"], ["level", "place", "link", "task_id"], position=F.lit(1))
    stuck = placed.where("level IS NULL").withColumn("position", _nothing("position"))
    return ranked.unionByName(stuck).select(*ORDERED.fieldNames())


def _release(tasks, edges, start):
    find = kernels.finder(tasks["graph_id"], tasks["task_id"])
    dependent = find(edges["graph_id"], edges["dependent_id"])
    dependency = find(edges["graph_id"], edges["dependency_id"])
    known = dependent >= 0
    waiting = np.bincount(dependent[known], minlength=len(tasks["task_id"]))
    usable = np.flatnonzero(known & (dependency >= 0))
    usable = usable[np.lexsort((edges["dependent_id"][usable], edges["edge_seq"][usable]))]
    links = kernels.Links(len(tasks["task_id"]), dependency[usable], dependent[usable])
    return kernels.release(links, start(waiting), waiting)


def _order_pack(tasks, edges):
    """All graphs of one pack at once; separate graphs do not disturb each other's order."""
    tasks = _once(tasks)

    def start(waiting):
        roots = np.flatnonzero(waiting == 0)
        return roots[np.lexsort((tasks["task_id"][roots], tasks["seq"][roots]))]

    level, order = _release(tasks, edges, start)
    order = order[np.argsort(tasks["graph_id"][order], kind="stable")]
    graphs = tasks["graph_id"][order]
    position = np.zeros(len(level), dtype=np.int64)
    position[order] = np.arange(len(order)) - np.searchsorted(graphs, graphs) + 1
    return {
        "graph_id": tasks["graph_id"],
        "task_id": tasks["task_id"],
        "level": nullable(level, level < 0),
        "position": nullable(position, level < 0),
    }


def _once(tasks):
    """Each task once, with its smallest ``seq``."""
    order = np.lexsort((tasks["seq"], tasks["task_id"], tasks["graph_id"]))
    graphs, ids = tasks["graph_id"][order], tasks["task_id"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (graphs[1:] != graphs[:-1]) | (ids[1:] != ids[:-1])
    return {name: values[order][new] for name, values in tasks.items()}


def _place_by_levels(tasks, edges):
    """Place of every task among those of its level, a run of levels of each graph at a time.

    Levels come first, by blocks. A task is then placed by its links from the level just below, so each
    link is stored once with the level it leads to, and links from further below are left out. The levels of a graph are cut in order into
    runs of about ``bucketRows`` tasks and links. A round takes the next run of every graph: a grouped Arrow task places all levels of
    its runs, and a level that is wider than a run by itself is placed by joins. A round reads its own links and the last level placed before.
    So the number of rounds is the most levels or twice the most runs a graph has, whichever is less, and a graph of up to a run takes one.
    """
    spark = tasks.sparkSession
    scratch = Scratch(spark, "order")
    key, none = ["graph_id", "task_id"], F.lit(0).cast("long")
    edges = scratch.put(edges, "edges")[0]
    tasks = scratch.put(tasks.groupBy(*key).agg(F.min("seq").alias("seq")), "tasks")[0]
    levelled = levels_by_blocks(tasks.select(*key), edges.withColumn("weight", F.lit(1).cast("long")), steps="releases")
    base, seen = scratch.put(levelled.join(tasks, key), "base", stuck=F.count_if(F.col("level").isNull()))
    reached = base.select("graph_id", F.col("task_id").alias("dependent_id"), "level").where("level > 0")
    source = base.select("graph_id", F.col("task_id").alias("dependency_id"), (F.col("level") + 1).alias("level"))
    # Those of a task that nothing holds back count as links from nothing.
    closing = edges.join(reached, ["graph_id", "dependent_id"]).join(source, ["graph_id", "dependency_id", "level"])
    closing = closing.select("graph_id", F.col("dependent_id").alias("task_id"), "level", "dependency_id", F.col("edge_seq").alias("link"))
    roots = base.where("level = 0").select(*key, "level", _nothing("dependency_id"), F.col("seq").alias("link"))
    closing = scratch.put(closing.unionByName(roots), "closing")[0]
    sizes, counted = scratch.put(closing.groupBy("graph_id", "level").agg(F.count(F.lit(1)).alias("size")), "sizes")
    rows = limit(spark, "bucketRows")
    runs = running_totals(sizes, ["graph_id"], ["level"], known_rows=counted["rows"], upto=F.col("size"))
    # A wide level comes first of what ends in the same stretch, as it began before it.
    runs = runs.select("graph_id", "level", (F.col("size") > rows).alias("wide"), F.expr(f"upto div {rows} * 2 + if(size > {rows}, 0, 1)").alias("run"))
    starts = runs.withColumn("new", F.expr("if(lag(run) OVER (PARTITION BY graph_id ORDER BY level) = run, 0, 1)")) if counted["rows"] <= limit(spark, "hotRows") else None
    if starts is None:
        starts = previous_value(runs, ["graph_id"], ["level"], "run", "before").withColumn("new", F.expr("if(before = run, 0, 1)")).drop("before")
    turns = running_totals(starts, ["graph_id"], ["level"], known_rows=counted["rows"], turn=F.col("new"))
    turns = scratch.put(turns.select("graph_id", "level", "wide", (F.col("turn") - 1).cast("int").alias("turn"), (F.col("turn") - 1).cast("int").alias("_turn")), "turns")[0]
    last = turns.groupBy("graph_id", F.col("_turn").alias("turn")).agg(F.max("level").alias("last"))
    todo = closing.join(turns.drop("_turn"), ["graph_id", "level"]).join(last, ["graph_id", "turn"])
    todo = scratch.put(todo.hint("rebalance", "turn", "wide"), "todo", partition_by=["turn", "wide"])[0]
    sized = {(row.turn, row.wide): row.n for row in todo.groupBy("turn", "wide").agg(F.count(F.lit(1)).alias("n")).collect()}
    tail, tail_rows = None, 0
    for turn in range(max((turn for turn, _ in sized), default=-1) + 1):
        mine = todo.where(F.col("turn") == turn)
        parts = []
        if (turn, False) in sized:
            parts.append(_place_runs(mine.where("NOT wide"), sized[turn, False], tail))
        if (turn, True) in sized:
            parts.append(_place_wide(mine.where("wide"), tail, tail_rows))
        step = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        table, counted = scratch.put(step, f"steps/round={turn}", partition_by=["ends"], ends=F.count_if("ends"))
        tail, tail_rows = table.where("ends"), counted["ends"]
    schema = T.StructType([*PLACED.fields, T.StructField("round", LONG, True), T.StructField("ends", T.BooleanType(), True)])
    stuck = base.where("level IS NULL").select(*key, *map(_nothing, ("level", "place", "link")))
    if not sized:
        return stuck
    placed = scratch.get("steps", schema).select(*PLACED.fieldNames())
    return placed.unionByName(stuck) if seen["stuck"] else placed


RUN = T.StructType([*PLACED.fields, T.StructField("ends", T.BooleanType(), True)])


def _place_wide(links, tail, tail_rows):
    """Places in levels of any width, from the places in the level before each (``tail``)."""
    key = ["graph_id", "task_id"]
    came = F.struct(F.coalesce("place", F.lit(0)).alias("place"), "link")
    if tail is None:
        links = links.withColumn("place", F.lit(0).cast("long"))
    else:
        below = tail.select("graph_id", F.col("task_id").alias("dependency_id"), "place")
        links = links.join(_sized(below, tail_rows), ["graph_id", "dependency_id"], "left")
    last = links.groupBy(*key).agg(F.max("level").alias("level"), F.max(came).alias("last")).select(*key, "level", "last.*")
    ranked = running_totals(last, ["graph_id"], ["place", "link", "task_id"], rank=F.lit(1))
    return ranked.select(*key, "level", F.col("rank").alias("place"), F.lit(0).cast("long").alias("link"), F.lit(True).alias("ends"))


def _place_runs(links, rows, tail):
    """Places in all levels of the runs whose ``links`` are given."""
    spark = links.sparkSession
    packs = max(-(-rows // limit(spark, "packRows")), min(spark.sparkContext.defaultParallelism, -(-rows // (limit(spark, "packRows") // 25 + 1))), 1)
    pack = F.pmod(F.xxhash64("graph_id"), F.lit(packs)).cast("int")
    links = links.select("graph_id", "task_id", "level", "last", F.col("dependency_id").isNull().cast("long").alias("root"), F.coalesce("dependency_id", F.lit(0)).alias("dependency_id"), "link")
    tables = [links.withColumn(PACK, pack)]
    if tail is not None:
        tables.append(tail.select("graph_id", "task_id", "place").withColumn(PACK, pack))
    return packed(_place_pack, RUN, packs, *tables)


def _place_pack(links, tail=None):
    if not len(links["graph_id"]):
        return {name: pa.array([], type=pa.bool_() if name == "ends" else pa.int64()) for name in RUN.fieldNames()}
    if tail is None:
        tail = {name: np.empty(0, dtype=np.int64) for name in ("graph_id", "task_id", "place")}
    of_graph = np.isin(tail["graph_id"], links["graph_id"])
    tail = {name: values[of_graph] for name, values in tail.items()}
    order = np.lexsort((links["task_id"], links["graph_id"]))
    graph, task = links["graph_id"][order], links["task_id"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (graph[1:] != graph[:-1]) | (task[1:] != task[:-1])
    one = order[new]
    n_tail = len(tail["graph_id"])
    graphs = np.concatenate([tail["graph_id"], graph[new]])
    find = kernels.finder(graphs, np.concatenate([tail["task_id"], task[new]]))
    linked = np.flatnonzero(links["root"] == 0)
    linked = linked[np.lexsort((links["task_id"][linked], links["link"][linked]))]
    dependent = find(links["graph_id"][linked], links["task_id"][linked])
    dependency = find(links["graph_id"][linked], links["dependency_id"][linked])
    waiting = np.bincount(dependent, minlength=len(graphs))
    # What is there at first, in the order it goes: the level before, or roots by insertion order.
    first = np.concatenate([np.arange(n_tail), n_tail + np.flatnonzero(links["root"][one] == 1)])
    roots = one[links["root"][one] == 1]
    by = np.concatenate([tail["place"], links["link"][roots]]), np.concatenate([tail["task_id"], links["task_id"][roots]])
    _, order = kernels.release(kernels.Links(len(graphs), dependency, dependent), first[np.lexsort((by[1], by[0]))], waiting)
    place = np.zeros(len(graphs), dtype=np.int64)
    place[order] = np.arange(len(order))
    level = links["level"][one]
    return {
        "graph_id": graphs[n_tail:], "task_id": task[new], "level": level, "place": place[n_tail:],
        "link": np.zeros(len(level), dtype=np.int64), "ends": level == links["last"][one],
    }


def _sized(rows, count):
    return F.broadcast(rows) if count <= limit(rows.sparkSession, "broadcastRows") else rows
