"""Checks, de-duplication and list forms of dependency edges.

An edge row (dependent_id, dependency_id) says: the dependent waits for the dependency.
"""

from pyspark.sql import functions as F

from depweave.functions.handles import in_range, is_valid_id
from depweave.plans.skew import attach, key_join, keys_above, running_totals, sized_broadcast

EDGE = ["graph_id", "dependent_id", "dependency_id"]
OFFER = ["dependent_graph_id", "dependent_id", "dependency_graph_id", "dependency_id"]


def classify_edges(cand, tasks, graphs=None):
    """Give each offered edge the first structural verdict that applies to it.

    In order: finalised, invalid_handle, cross_graph, self, missing, repeat, ok. ``repeat``
    marks every offer of the same edge after the one with the smallest ``seq``, which must
    be unique. Cycles are judged elsewhere.
    """
    known = tasks.select("graph_id", "task_id").distinct()

    def exists(side):
        return known.select(
            F.col("graph_id").alias(f"{side}_graph_id"),
            F.col("task_id").alias(f"{side}_id"),
            F.lit(True).alias(f"_has_{side}"),
        )

    # Joined with seq among the keys, so an edge offered very often still spreads out.
    firsts = (
        cand.groupBy(*OFFER)
        .agg(F.min("seq").alias("seq"))
        .withColumn("_first", F.lit(True))
    )
    checked = (
        key_join(cand, firsts, ["seq", *OFFER], "left")
        .join(exists("dependent"), ["dependent_graph_id", "dependent_id"], "left")
        .join(exists("dependency"), ["dependency_graph_id", "dependency_id"], "left")
    )
    frozen = F.lit(False)
    if graphs is not None:
        finalised = graphs.where("finalised").select(
            F.col("graph_id").alias("dependent_graph_id"), F.lit(True).alias("_frozen")
        )
        checked = attach(checked, finalised.distinct(), ["dependent_graph_id"], sized_by=cand)
        frozen = F.col("_frozen").isNotNull()
    # A missing graph id is no handle out of range; its tasks are missing.
    off = ~in_range("dependent_graph_id") | ~in_range("dependency_graph_id")
    invalid = ~(is_valid_id("dependent_id") & is_valid_id("dependency_id")) | F.coalesce(off, F.lit(False))
    same_graph = F.col("dependent_graph_id").eqNullSafe(F.col("dependency_graph_id"))
    verdict = (
        F.when(frozen, "finalised")
        .when(invalid, "invalid_handle")
        .when(~same_graph, "cross_graph")
        .when(F.col("dependent_id") == F.col("dependency_id"), "self")
        .when(F.col("_has_dependent").isNull() | F.col("_has_dependency").isNull(), "missing")
        .when(F.col("_first").isNull(), "repeat")
        .otherwise("ok")
    )
    return checked.select(*[F.col(c) for c in cand.columns], verdict.alias("verdict"))


def as_edges(offers):
    """Edge rows of offers whose two ends are in the same graph."""
    return offers.select(
        F.col("dependent_graph_id").alias("graph_id"),
        F.col("seq").alias("edge_seq"),
        "dependent_id",
        "dependency_id",
    )


def dedupe_edges(edges):
    """Keep the first offer of each edge, by ``edge_seq``."""
    others = [c for c in edges.columns if c not in EDGE and c != "edge_seq"]
    kept = edges.groupBy(*EDGE).agg(F.min(F.struct("edge_seq", *others)).alias("_kept"))
    return kept.select(*[F.col(c) if c in EDGE else F.col(f"_kept.{c}") for c in edges.columns])


def degrees(tasks, edges):
    """Number of dependencies and of dependents of every task.

    Tasks and both ends of all edges go through one partial aggregation, so a task that
    takes part in very many edges costs one row per map task in the shuffle.
    """
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = F.explode(
        F.array(
            F.struct(F.col("dependent_id").alias("task_id"), one.alias("ins"), none.alias("outs")),
            F.struct(F.col("dependency_id").alias("task_id"), none.alias("ins"), one.alias("outs")),
        )
    )
    counted = edges.select("graph_id", ends.alias("end")).select("graph_id", "end.*", F.lit(False).alias("known"))
    rows = tasks.select("graph_id", "task_id", none.alias("ins"), none.alias("outs"), F.lit(True).alias("known"))
    return (
        rows.unionByName(counted)
        .groupBy("graph_id", "task_id")
        .agg(
            F.sum("ins").alias("n_dependencies"),
            F.sum("outs").alias("n_dependents"),
            F.max("known").alias("known"),
        )
        .where("known")
        .drop("known")
    )


def _list_parts(entries, keys, most):
    """Add ``part``: 0, except that a list of more than ``most`` entries is cut by rank."""
    parted = entries.withColumn("part", F.lit(0).cast("long"))
    hubs = keys_above(entries.select(*keys), keys, most)
    if hubs is None:
        return parted
    hubs = sized_broadcast(hubs)
    long_lists = key_join(entries, hubs, keys, "left_semi")
    ranked = running_totals(long_lists, keys, ["edge_seq"], _rank=F.lit(1))
    ranked = ranked.withColumn("part", F.expr(f"(_rank - 1) div {most}")).drop("_rank")
    return key_join(parted, hubs, keys, "left_anti").unionByName(ranked)


def adjacency(tasks, edges, part_size=100_000):
    """Ordered dependency and dependent lists of every task, empty lists included.

    A list of n entries is on ceil(n / part_size) rows: ``part`` is 0 on the first, and each
    further row has the next ``part_size`` entries. The key is (graph_id, task_id, part) at any
    size of the data, and no session setting has a part in it.
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("dependent_id").alias("task_id"), F.lit(True).alias("waits"), F.col("dependency_id").alias("other")),
            F.struct(F.col("dependency_id").alias("task_id"), F.lit(False).alias("waits"), F.col("dependent_id").alias("other")),
        )
    )
    entries = edges.select("graph_id", "edge_seq", ends.alias("end")).select("graph_id", "edge_seq", "end.*")
    parted = _list_parts(entries, ["graph_id", "task_id", "waits"], part_size).withColumn("known", F.lit(False))
    base = tasks.select("graph_id", "task_id", F.lit(0).cast("long").alias("part"), F.lit(True).alias("known"))

    def listed(side):
        entry = F.when(side, F.struct("edge_seq", "other"))
        return F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["other"])

    lists = (
        base.unionByName(parted, allowMissingColumns=True)
        .groupBy("graph_id", "task_id", "part")
        .agg(
            F.max("known").alias("known"),
            listed(F.col("waits")).alias("dependencies"),
            listed(~F.col("waits")).alias("dependents"),
        )
    )
    further = lists.where("part > 0").join(tasks.select("graph_id", "task_id"), ["graph_id", "task_id"], "left_semi")
    return lists.where("part = 0 AND known").unionByName(further).drop("known")


def remove_edges(edges, doomed):
    """Delete the listed edges; edges that are not there are ignored."""
    return edges.join(doomed, EDGE, "left_anti")


def audit_links(adj):
    """Links recorded by only one of their two tasks, and by which one."""
    seen_by_dependent = adj.select(
        "graph_id",
        F.col("task_id").alias("dependent_id"),
        F.explode("dependencies").alias("dependency_id"),
        F.lit("dependent").alias("side"),
    )
    seen_by_dependency = adj.select(
        "graph_id",
        F.explode("dependents").alias("dependent_id"),
        F.col("task_id").alias("dependency_id"),
        F.lit("dependency").alias("side"),
    )
    return (
        seen_by_dependent.unionByName(seen_by_dependency)
        .groupBy(*EDGE)
        .agg(F.min("side").alias("side"), F.max("side").alias("_other"))
        .where(F.col("side") == F.col("_other"))
        .drop("_other")
    )
