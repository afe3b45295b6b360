"""Levels of large graphs, a block of neighbouring tasks at a time.

Tasks are cut in id order into blocks of about ``bucketRows`` tasks and outgoing links, larger where a graph would be
cut into more blocks than keep the cores busy; graphs below that size share blocks. A block's tasks and links are
grouped once, into one row of arrays. A round hands the messages of the round before to their blocks: a
grouped Arrow task releases all that its block can release, along any number of its own links, and
sends one message to each task it reaches in another block. So the number of rounds is how often a path
changes its block, never more than the number of levels, and few where tasks come after what they wait for.

A round moves messages and the arrays of the blocks that get some; links are joined with tasks once, before the
first round. A task with more links than a block may hold keeps them in a table of their own, joined when it is released.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.plans import kernels
from depweave.plans.limits import limit
from depweave.plans.packs import PACK, nullable, packed
from depweave.plans.scratch import Scratch
from depweave.plans.skew import running_totals, sized_broadcast
from depweave.schemas import LONG

KEY = ["graph_id", "task_id"]
STATE, MESSAGE, HUB, BLOCK = 0, 1, 2, 3
STEP = T.StructType([T.StructField(c, LONG, True) for c in ("kind", "block", *KEY, "n", "level")] + [T.StructField("data", T.BinaryType(), True)])
LEVELLED = T.StructType([T.StructField(c, LONG, True) for c in (*KEY, "level")])


def levels_by_blocks(tasks, edges, steps="steps"):
    """(graph_id, task_id, level) of distinct ``tasks``; NULL for a task that is never released.

    ``edges`` (graph_id, dependent_id, dependency_id, weight): a level is the largest sum of a dependency's level
    and the weight. A dependency that is not among the tasks never completes. The rounds are written in the folder ``steps``.
    """
    spark = tasks.sparkSession
    scratch = Scratch(spark, "blocks")
    edges, seen = scratch.put(edges.select("graph_id", "dependent_id", "dependency_id", "weight"), "edges")
    base, n_blocks, any_hub = _dealt(tasks, edges, seen["rows"], scratch)
    source = base.select("graph_id", F.col("task_id").alias("dependency_id"), "block", "hub")
    target = base.select("graph_id", F.col("task_id").alias("dependent_id"), F.col("block").alias("to_block"))
    links = edges.join(target, ["graph_id", "dependent_id"]).join(source, ["graph_id", "dependency_id"])
    wide = None
    if any_hub:
        links = scratch.put(links, "links")[0]
        wide = scratch.put(links.where("hub").drop("block", "hub"), "wide")[0]
        links = links.where("NOT hub")
    packs = max(1, min(n_blocks, 8 * spark.sparkContext.defaultParallelism))
    schema = T.StructType([*STEP.fields, T.StructField("round", LONG, True)])
    first = packed(_make_block, STEP, packs, base.withColumn(PACK, F.col("block").cast("int")), links.drop("hub").withColumn(PACK, F.col("block").cast("int")))
    # Per block the round that wrote its newest state.
    newest, step, turn = {block: 0 for block in range(n_blocks)}, first, 0

    def arrays(wanted):
        """The arrays and the newest state of the blocks ``wanted``."""
        by_round = {}
        for block in wanted:
            by_round.setdefault(newest[block], []).append(block)
        of_round = [(F.col("round") == r) & F.col("block").isin(some) for r, some in by_round.items()]
        if not of_round:
            of_round = [F.lit(False)]
        fixed = (F.col("kind") == BLOCK) & (F.col("round") == 0)
        fixed = fixed & F.col("block").isin(list(wanted)) if len(wanted) < n_blocks else fixed
        rows = scratch.get(steps, schema).where(fixed | ((F.col("kind") == STATE) & reduce(lambda a, b: a | b, of_round)))
        return rows.select("kind", "block", "data", F.col("block").cast("int").alias(PACK))

    while True:
        table, seen = scratch.put(step, f"{steps}/round={turn}", partition_by=["kind"], sent=F.count_if(F.col("kind") == MESSAGE), hubs=F.count_if(F.col("kind") == HUB))
        if turn:
            # What this round has read is replaced.
            for old in range(turn):
                if old not in newest.values():
                    scratch.drop(f"{steps}/round={old}/kind={STATE}")
            scratch.drop(f"{steps}/round={turn - 1}/kind={MESSAGE}")
        if not seen["sent"] and not seen["hubs"]:
            break
        sent = table.where(F.col("kind") == MESSAGE).select("block", *KEY, "n", "level")
        if seen["hubs"]:
            hubs = table.where(F.col("kind") == HUB).select("graph_id", F.col("task_id").alias("dependency_id"), "level")
            hub_links = wide.join(F.broadcast(hubs), ["graph_id", "dependency_id"])
            hub_sent = hub_links.groupBy("graph_id", F.col("dependent_id").alias("task_id")).agg(
                F.max("to_block").alias("block"), F.count(F.lit(1)).alias("n"), F.max(F.col("level") + F.col("weight")).alias("level")
            )
            sent = scratch.put(sent.unionByName(hub_sent.select(*sent.columns)), f"sent-{turn}")[0]
        wanted = [row.block for row in sent.select("block").distinct().collect()]
        if not wanted:
            break
        step = packed(_run_block, STEP, packs, arrays(wanted), sent.withColumn(PACK, F.col("block").cast("int")))
        turn += 1
        newest.update(dict.fromkeys(wanted, turn))
    return packed(_levels_of_block, LEVELLED, packs, arrays(range(n_blocks)))


def _dealt(tasks, edges, n_edges, scratch):
    """Tasks with what they need, their block and whether they are hubs; the number of blocks; whether there are hubs."""
    spark, none = tasks.sparkSession, F.lit(0).cast("long")
    needed = edges.groupBy("graph_id", F.col("dependent_id").alias("task_id")).agg(F.count(F.lit(1)).alias("needed"))
    out = edges.groupBy("graph_id", F.col("dependency_id").alias("task_id")).agg(F.count(F.lit(1)).alias("out"))
    base = tasks.select(*KEY).join(needed, KEY, "left").join(out, KEY, "left")
    base, seen = scratch.put(base.select(*KEY, F.coalesce("needed", none).alias("needed"), F.coalesce("out", none).alias("out")), "needs")
    least = limit(spark, "bucketRows")
    rows = max(least, min(limit(spark, "graphRows"), (seen["rows"] + n_edges) // (2 * spark.sparkContext.defaultParallelism)))
    hub = F.col("out") > rows
    base = base.select(*KEY, "needed", hub.alias("hub"), F.when(hub, 1).otherwise(F.col("out") + 1).alias("size"))
    base = running_totals(base, ["graph_id"], ["task_id"], known_rows=seen["rows"], upto=F.col("size")).drop("size")
    base, seen = scratch.put(base, "placed", hubs=F.count_if("hub"))
    sizes = scratch.put(base.groupBy("graph_id").agg(F.max("upto").alias("size")), "sizes")[0]
    # At most one graph for so many rows.
    large, blocks = [], 0
    for row in sizes.where(F.col("size") > rows).collect():
        large.append((row.graph_id, blocks))
        blocks += row["size"] // rows + 1
    shared = -(-(sizes.where(F.col("size") <= rows).agg(F.coalesce(F.sum("size"), none)).first()[0]) // rows)
    block = F.pmod(F.xxhash64("graph_id"), F.lit(max(shared, 1))) + F.lit(blocks)
    if large:
        offsets = sized_broadcast(spark.createDataFrame(large, "graph_id long, _offset long"))
        base = base.join(offsets, "graph_id", "left")
        block = F.coalesce(F.col("_offset") + F.expr(f"upto div {rows}"), block)
    base = scratch.put(base.select(*KEY, "needed", "hub", block.cast("long").alias("block")), "tasks")[0]
    return base, blocks + shared, seen["hubs"] > 0


def _bytes(*arrays):
    return np.concatenate([np.array([len(arrays), *map(len, arrays)]), *arrays]).astype(np.int64).tobytes()


def _arrays(data):
    values = np.frombuffer(data, dtype=np.int64)
    ends = np.cumsum(values[: values[0] + 1])[1:] + 1
    return [values[end - n : end] for end, n in zip(ends, values[1 : values[0] + 1])]


def _make_block(tasks, links):
    """A block's arrays; links go out from their task to a place in the block, or to block -1 - place."""
    order = np.lexsort((tasks["task_id"], tasks["graph_id"]))
    block, graphs, ids = tasks["block"][0], tasks["graph_id"][order], tasks["task_id"][order]
    find = kernels.finder(graphs, ids)
    source = find(links["graph_id"], links["dependency_id"])
    by_source = np.argsort(source, kind="stable")
    links = {name: values[by_source] for name, values in links.items()}
    first = np.searchsorted(source[by_source], np.arange(len(ids) + 1))
    inside = links["to_block"] == block
    place = -1 - links["to_block"]
    place[inside] = find(links["graph_id"][inside], links["dependent_id"][inside])
    fixed = _bytes(graphs, ids, tasks["hub"][order], first, place, links["dependent_id"], links["weight"])
    return _released(block, fixed, tasks["needed"][order].copy(), np.zeros(len(ids), dtype=np.int64), [(BLOCK, fixed)])


def _run_block(rows, sent):
    data = dict(zip(rows["kind"].tolist(), rows["data"]))
    waiting, level = (values.copy() for values in _arrays(data[STATE]))
    graphs, ids = _arrays(data[BLOCK])[:2]
    one = graphs[0] == graphs[-1]
    at = np.searchsorted(ids, sent["task_id"]) if one else kernels.finder(graphs, ids)(sent["graph_id"], sent["task_id"])
    np.subtract.at(waiting, at, sent["n"])
    np.maximum.at(level, at, sent["level"])
    return _released(rows["block"][0], data[BLOCK], waiting, level, [])


def _released(block, fixed, waiting, level, kept):
    """Release what the block can release; a released task's count is -1."""
    graphs, ids, hub, first, place, target, weight = _arrays(fixed)
    wave, sent, hubs = np.flatnonzero(waiting == 0), [], []
    while len(wave):
        hubs.append(wave[hub[wave] == 1])
        counts = first[wave + 1] - first[wave]
        origin = np.repeat(np.arange(len(wave)), counts)
        link = first[wave][origin] + np.arange(len(origin)) - np.repeat(counts.cumsum() - counts, counts)
        reached, to = level[wave][origin] + weight[link], place[link]
        away = to < 0
        sent.append((-1 - to[away], graphs[wave][origin][away], target[link][away], reached[away]))
        waiting[wave] = -1
        hit = to[~away]
        np.maximum.at(level, hit, reached[~away])
        np.subtract.at(waiting, hit, 1)
        wave = np.unique(hit[waiting[hit] == 0])
    rows = [([kind], [block], [None], [None], [None], [None], [data]) for kind, data in [*kept, (STATE, _bytes(waiting, level))]]
    if sent:
        to, graph, task, reached = (np.concatenate(part) for part in zip(*sent))
        order = np.lexsort((task, graph, to))
        to, graph, task, reached = to[order], graph[order], task[order], reached[order]
        new = np.ones(len(to), dtype=bool)
        new[1:] = (to[1:] != to[:-1]) | (graph[1:] != graph[:-1]) | (task[1:] != task[:-1])
        start = np.flatnonzero(new)
        if len(start):
            n = len(start)
            rows.append((np.full(n, MESSAGE), to[start], graph[start], task[start], np.diff(np.append(start, len(to))), np.maximum.reduceat(reached, start), [None] * n))
        hubs = np.concatenate(hubs)
        n = len(hubs)
        rows.append((np.full(n, HUB), np.full(n, block), graphs[hubs], ids[hubs], np.zeros(n), level[hubs], [None] * n))
    types = [pa.int64()] * 6 + [pa.binary()]
    return {
        name: pa.concat_arrays([pa.array(row[i], type=kind) for row in rows]) for i, (name, kind) in enumerate(zip(STEP.fieldNames(), types))
    }


def _levels_of_block(rows):
    data = dict(zip(rows["kind"].tolist(), rows["data"]))
    waiting, level = _arrays(data[STATE])
    graphs, ids = _arrays(data[BLOCK])[:2]
    return {"graph_id": graphs, "task_id": ids, "level": nullable(level, waiting >= 0)}
