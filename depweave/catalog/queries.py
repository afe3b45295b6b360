"""One query per operator, over whole tables derived from the given parquet files."""

from pyspark.sql import functions as F

from depweave.functions.checksum import limbs_to_decimal, rolling_checksum, seal_frame as seal
from depweave.functions.handles import handle_key as key_of
from depweave.operators import cycles, edges, frames, identity, objects, order, reach, runs
from depweave.plans.scratch import Scratch
from depweave.schemas import COMPLETIONS
from depweave.sources import fixtures as fx
from depweave.streaming import drain as streams
from depweave.streaming import release

CULL_LIMIT = 0.1


def _settled(spark, df, label):
    """A derived input, written once because several steps read it."""
    return Scratch(spark, label).put(df, "rows")[0]


def _or_zero(name):
    """Shown as 0 where missing, so that both sides of a comparison stay integers."""
    return F.coalesce(name, F.lit(0)).cast("long").alias(name)


def _tasks(spark, sf_dir):
    return _settled(spark, fx.event_tasks(spark, sf_dir), "tasks")


def _graph(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    return tasks, _settled(spark, fx.event_edges(tasks), "edges")


def _graphs(spark, sf_dir):
    """Graphs that are offered to or from: the last one has no tasks."""
    cand = fx.event_candidates(spark, sf_dir)
    ends = F.explode(F.array("dependent_graph_id", "dependency_graph_id")).alias("graph_id")
    return cand.select(ends).distinct()


def _good_edges(spark, sf_dir):
    """Tasks and the structurally good offers, which may hold cycles."""
    tasks = _tasks(spark, sf_dir)
    judged = edges.classify_edges(fx.event_candidates(spark, sf_dir), tasks)
    good = edges.as_edges(judged.where("verdict = 'ok'"))
    return tasks, _settled(spark, good, "good")


def assign_ids(spark, sf_dir):
    return fx.event_tasks(spark, sf_dir).select("graph_id", "task_id", "seq", "name")


def valid_handles(spark, sf_dir):
    cand = fx.event_candidates(spark, sf_dir)
    return identity.valid_handles(cand, "dependent_id").select("seq", "dependent_graph_id", "dependent_id")


def handle_key(spark, sf_dir):
    tasks = fx.event_tasks(spark, sf_dir)
    return tasks.select("graph_id", "task_id", key_of("graph_id", "task_id").alias("handle_key"))


def lookup_tasks(spark, sf_dir):
    handles = fx.event_candidates(spark, sf_dir).select(
        F.col("seq").alias("offer"),
        F.col("dependency_graph_id").alias("graph_id"),
        F.col("dependency_id").alias("task_id"),
    )
    tasks = fx.event_tasks(spark, sf_dir).select("graph_id", "task_id", "seq", "name")
    found = identity.lookup_tasks(handles, tasks)
    return found.select("offer", "graph_id", "task_id", _or_zero("seq"), "name", "found")


def list_tasks(spark, sf_dir):
    return identity.list_tasks(fx.event_tasks(spark, sf_dir).select("graph_id", "task_id", "seq", "name"))


def task_counts(spark, sf_dir):
    return identity.task_counts(_graphs(spark, sf_dir), fx.event_tasks(spark, sf_dir))


def append_tasks(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    new = fx.table(spark, sf_dir, "events").where("event_type = 'signup'")
    new = new.selectExpr("user_id AS graph_id", "event_id AS seq", "event_type AS name")
    added = identity.append_tasks(tasks, fx.graphs_of(tasks), new)
    return added.select("accepted", "graph_id", _or_zero("task_id"), "seq", "name")


def classify_edges(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    return edges.classify_edges(fx.event_candidates(spark, sf_dir), tasks, fx.graphs_of(tasks))


def dedupe_edges(spark, sf_dir):
    offers = fx.event_candidates(spark, sf_dir).where("dependent_graph_id = dependency_graph_id")
    return edges.dedupe_edges(edges.as_edges(offers))


def adjacency(spark, sf_dir):
    listed = edges.adjacency(*_graph(spark, sf_dir))
    return listed.select(
        "graph_id",
        "task_id",
        "part",
        F.concat_ws(",", F.col("dependencies").cast("array<string>")).alias("dependencies"),
        F.concat_ws(",", F.col("dependents").cast("array<string>")).alias("dependents"),
    )


def degrees(spark, sf_dir):
    return edges.degrees(*_graph(spark, sf_dir))


def remove_edges(spark, sf_dir):
    _, graph = _graph(spark, sf_dir)
    doomed = graph.where("edge_seq % 5 = 0").select(*edges.EDGE)
    absent = doomed.withColumn("dependent_id", F.lit(0).cast("long"))
    kept = edges.remove_edges(graph, doomed.unionByName(absent))
    return kept.select("graph_id", "edge_seq", "dependent_id", "dependency_id")


def audit_links(spark, sf_dir):
    tasks, graph = _graph(spark, sf_dir)
    nothing = F.array().cast("array<bigint>")
    by_dependent = edges.adjacency(tasks, graph).withColumn("dependents", nothing)
    by_dependency = edges.adjacency(tasks, graph.where("edge_seq % 7 <> 0")).withColumn("dependencies", nothing)
    return edges.audit_links(by_dependent.unionByName(by_dependency))


def reachable(spark, sf_dir):
    tasks, graph = _graph(spark, sf_dir)
    seeds = tasks.groupBy("graph_id").agg(F.max("task_id").alias("task_id"))
    return reach.reachable(graph, seeds)


def reachable_rounds(spark, sf_dir):
    tasks, graph = _graph(spark, sf_dir)
    return reach.reachable(graph, tasks.groupBy("graph_id").agg(F.max("task_id").alias("task_id")), plan="rounds")


def cycle_members_rounds(spark, sf_dir):
    return cycles.cycle_members(*_good_edges(spark, sf_dir), plan="rounds")


def fifo_order_rounds(spark, sf_dir):
    return order.fifo_order(*_graph(spark, sf_dir), plan="rounds")


def probe_cycles(spark, sf_dir):
    tasks, probes = _good_edges(spark, sf_dir)
    return reach.probe_cycles(_settled(spark, fx.event_edges(tasks), "edges"), probes)


def probe_cycles_rounds(spark, sf_dir):
    tasks, probes = _good_edges(spark, sf_dir)
    return reach.probe_cycles(_settled(spark, fx.event_edges(tasks), "edges"), probes, plan="rounds")


def cyclic_core(spark, sf_dir):
    return cycles.cyclic_core(*_good_edges(spark, sf_dir))


def cyclic_core_rounds(spark, sf_dir):
    return cycles.cyclic_core(*_good_edges(spark, sf_dir), plan="rounds")


def cycle_members(spark, sf_dir):
    return cycles.cycle_members(*_good_edges(spark, sf_dir))


def admit_edges(spark, sf_dir):
    return cycles.admit_edges(fx.event_candidates(spark, sf_dir), _tasks(spark, sf_dir))


def admit_edges_rounds(spark, sf_dir):
    """Every component by halves and batches of eight offers, as components beyond one task are."""
    return cycles.admit_edges(fx.event_candidates(spark, sf_dir), _tasks(spark, sf_dir), plan="rounds", batch=8)


def roots_and_leaves(spark, sf_dir):
    return order.roots_and_leaves(*_graph(spark, sf_dir))


def validate_graphs(spark, sf_dir):
    tasks, good = _good_edges(spark, sf_dir)
    # Every third graph is frozen already.
    graphs = _graphs(spark, sf_dir).withColumn("finalised", F.expr("graph_id % 3 = 0"))
    return order.validate_graphs(graphs, tasks, good)


def levels(spark, sf_dir):
    return order.levels(*_graph(spark, sf_dir))


def levels_one_graph(spark, sf_dir):
    """One large graph: a round of joins per level, whatever the size of the tables here."""
    return order.levels(fx.order_tasks(spark, sf_dir), _settled(spark, fx.order_edges(spark, sf_dir), "edges"), plan="rounds")


def levels_chains(spark, sf_dir):
    """One large graph of long chains, contracted before its levels are found."""
    return order.levels(fx.order_tasks(spark, sf_dir), _settled(spark, fx.order_chains(spark, sf_dir), "edges"), plan="chains")


def fifo_order(spark, sf_dir):
    return order.fifo_order(*_graph(spark, sf_dir))


def ready_tasks(spark, sf_dir):
    tasks, graph = _graph(spark, sf_dir)
    return runs.ready_tasks(tasks, graph, tasks.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"))


def _outcomes(tasks):
    error = F.when(F.col("failed"), F.format_string("task %d failed", "task_id"))
    return tasks.select("graph_id", "task_id", "failed", error.alias("error"), "cost_us")


def _run(spark, sf_dir):
    tasks, graph = _graph(spark, sf_dir)
    run = runs.run_outcome(order.fifo_order(tasks, graph), _outcomes(tasks))
    return tasks, graph, run


def run_outcome(spark, sf_dir):
    return _run(spark, sf_dir)[2].select("graph_id", "task_id", "level", "position", "outcome")


def _summary(spark, sf_dir):
    tasks, graph, run = _run(spark, sf_dir)
    run = _settled(spark, run, "run")
    # The run already knows the levels, so freezing needs no second pass over the edges.
    validity = order.validity_from_levels(_graphs(spark, sf_dir), tasks, run)
    return runs.run_summary(run, validity)


def run_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


def run_timeline(spark, sf_dir):
    return runs.run_timeline(_run(spark, sf_dir)[2]).select("graph_id", "task_id", "start_us", "end_us")


def render_report(spark, sf_dir):
    return runs.render_report(_summary(spark, sf_dir))


def _total_cost(group):
    if group["failed"].any():
        raise ValueError("a task of this graph failed")
    return group.groupby("graph_id", as_index=False)["cost_us"].sum()


def _sum_parts(parts):
    return parts.groupby("graph_id", as_index=False)["cost_us"].sum()


def guarded_apply(spark, sf_dir):
    tasks = fx.event_tasks(spark, sf_dir).select("graph_id", "failed", "cost_us")
    results, errors = runs.guarded_apply(
        tasks, ["graph_id"], _total_cost, "graph_id long, cost_us long", merge=_sum_parts
    )
    none = F.lit(None).cast("string")
    good = results.select("graph_id", F.lit("Success").alias("status"), "cost_us", none.alias("error"))
    return good.unionByName(errors.withColumn("cost_us", F.lit(0).cast("long")))


def _completions(spark, sf_dir, tasks):
    """Events as a stream of completions; the task behind an event is looked up statically."""
    schema = fx.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    known = tasks.select(F.col("seq").alias("event_id"), "graph_id", "task_id", "failed")
    return events.select("event_id", "ts").join(known, "event_id").select(*COMPLETIONS.fieldNames())


def _releases(spark, sf_dir, delay):
    tasks, graph = _graph(spark, sf_dir)
    indegree = edges.degrees(tasks, graph).where("n_dependencies > 0")
    stream = release.release_stream(_completions(spark, sf_dir, tasks), graph, indegree, delay)
    return streams.drain(stream, "update").drop("batch")


def release_stream(spark, sf_dir):
    return _releases(spark, sf_dir, None)


def release_stream_delay(spark, sf_dir):
    """Completions at most an hour late; the state of released tasks is freed."""
    return _releases(spark, sf_dir, "1 hour")


def run_progress_stream(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    totals = identity.task_counts(fx.graphs_of(tasks), tasks)
    stream = release.run_progress_stream(_completions(spark, sf_dir, tasks), totals)
    return streams.latest(streams.drain(stream, "update"), ["graph_id"])


def init_frames(spark, sf_dir):
    return frames.init_frames(fx.frames(spark, sf_dir)).select(
        "frame_id",
        F.size("visible").cast("long").alias("n_visible"),
        "uploaded_bytes",
        F.col("presented_checksum").cast("string").alias("presented_checksum"),
        "frame_prepared",
        "simulation_updated",
        "frame_presented",
    )


def _exploded(df, column):
    parts = df.select("frame_id", F.posexplode(column).alias("idx", "position"))
    return parts.select("frame_id", F.col("idx").cast("long").alias("idx"), F.col("position").cast("double").alias("position"))


def integrate(spark, sf_dir):
    return _exploded(frames.integrate(fx.frames(spark, sf_dir)), "positions")


def upload_total(spark, sf_dir):
    totals = frames.upload_total(fx.frames(spark, sf_dir).select("frame_id"), fx.resources(spark, sf_dir))
    return totals.select("frame_id", "uploaded_bytes")


def cull(spark, sf_dir):
    return _exploded(frames.cull(fx.frames(spark, sf_dir), CULL_LIMIT), "visible")


def _checksummed(spark, sf_dir):
    return fx.frames(spark, sf_dir).withColumn("sum", rolling_checksum(F.col("frame_id"), F.col("positions")))


def checksum(spark, sf_dir):
    total = limbs_to_decimal(F.col("sum")).cast("string")
    return _checksummed(spark, sf_dir).select("frame_id", total.alias("checksum"))


def seal_frame(spark, sf_dir):
    sealed = limbs_to_decimal(seal(F.col("sum"), F.size("positions"))).cast("string")
    return _checksummed(spark, sf_dir).select("frame_id", sealed.alias("sealed"))


def require_stage(spark, sf_dir):
    loaded = frames.upload_total(fx.frames(spark, sf_dir).select("frame_id"), fx.resources(spark, sf_dir))
    flagged = frames.require_stage(loaded, "uploaded_bytes >= 2000", "too little uploaded", mode="flag")
    return flagged.select("frame_id", "uploaded_bytes", "stage_error")


def frame_pipeline(spark, sf_dir):
    done = frames.frame_pipeline(fx.frames(spark, sf_dir), fx.resources(spark, sf_dir), limit=CULL_LIMIT)
    return done.select(
        "frame_id",
        F.size("visible").cast("long").alias("n_visible"),
        "uploaded_bytes",
        F.col("presented_checksum").cast("string").alias("presented_checksum"),
        "frame_presented",
    )


def object_pipeline(spark, sf_dir):
    table = fx.frames(spark, sf_dir)
    pairs = table.select("frame_id", F.posexplode(F.arrays_zip("positions", "velocities")).alias("idx", "pair"))
    rows = pairs.select("frame_id", "idx", F.col("pair.positions").alias("position"), F.col("pair.velocities").alias("velocity"))
    done = objects.object_pipeline(table, rows, fx.resources(spark, sf_dir), limit=CULL_LIMIT)
    return done.select("frame_id", "n_visible", "uploaded_bytes", F.col("presented_checksum").cast("string").alias("presented_checksum"))


QUERIES = {
    query.__name__: query
    for query in (
        assign_ids, valid_handles, handle_key, lookup_tasks, list_tasks, task_counts, append_tasks,
        classify_edges, dedupe_edges, adjacency, degrees, remove_edges, audit_links,
        reachable, probe_cycles, cyclic_core, cycle_members, admit_edges, roots_and_leaves,
        validate_graphs, levels, levels_one_graph, levels_chains, fifo_order, admit_edges_rounds,
        reachable_rounds, probe_cycles_rounds, cyclic_core_rounds, cycle_members_rounds, fifo_order_rounds,
        ready_tasks, run_outcome, run_summary, run_timeline, render_report, guarded_apply,
        release_stream, release_stream_delay, run_progress_stream,
        init_frames, integrate, upload_total, cull, seal_frame, require_stage, frame_pipeline, object_pipeline,
    )
}
QUERIES["rolling_checksum"] = checksum
