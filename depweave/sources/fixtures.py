"""Graph and frame tables derived from the given parquet tables."""

from pyspark.sql import functions as F

from depweave.operators.identity import assign_ids
from depweave.plans.skew import previous_value


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tasks(spark, sf_dir):
    """One graph per user: many small graphs."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = events.select(
        F.col("user_id").alias("graph_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("name"),
        "ts",
        ((F.col("event_type") == "error") & (F.col("value") > 150)).alias("failed"),
        F.round(F.col("value") * 100).cast("long").alias("cost_us"),
    )
    return assign_ids(rows, "graph_id", ["ts", "seq"])


def event_edges(tasks):
    """Acyclic edges over `event_tasks`; the first three tasks of each graph are roots.

    A task id occurs once per graph, so only the two slots of one row can give the same edge; slot 0 has the smaller number.
    """
    late = tasks.where("task_id > 3").withColumns({"_near": F.expr("1 + seq % (task_id - 1)"), "_far": F.expr("1 + seq div 7 % (task_id - 1)")})
    slots = late.withColumn("slot", F.explode(F.when(F.col("_near").eqNullSafe(F.col("_far")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    return slots.select(
        "graph_id",
        F.col("task_id").alias("dependent_id"),
        F.expr("if(slot = 0, _near, _far)").alias("dependency_id"),
        F.expr("((seq * 7919) % 1000003) * 2 + slot").alias("edge_seq"),
    )


def event_candidates(spark, sf_dir):
    """Offered edges with every kind of defect."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    sizes = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return events.join(sizes, "user_id").selectExpr(
        "event_id AS seq",
        "user_id AS dependent_graph_id",
        "event_id % (n + 2) AS dependent_id",
        "if(event_id % 11 = 0, user_id + 1, user_id) AS dependency_graph_id",
        "(event_id div 3) % (n + 2) AS dependency_id",
    )


def graphs_of(tasks):
    """Every third graph is frozen."""
    return tasks.select("graph_id").distinct().withColumn("finalised", F.expr("graph_id % 3 = 0"))


def order_tasks(spark, sf_dir):
    """All orders as the tasks of one large graph."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(1 AS BIGINT) AS graph_id", "o_orderkey + 1 AS task_id", "o_orderkey + 1 AS seq"
    )


def order_edges(spark, sf_dir):
    """Each order waits for its customer's previous order and for the order at half its key."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey + 1 AS k")
    chained = previous_value(orders, ["o_custkey"], ["k"], "k", "p").select("k", "p")
    halved = orders.where("k > 1").selectExpr("k", "k div 2 AS p")
    return (
        chained.where("p IS NOT NULL")
        .unionByName(halved)
        .distinct()
        .selectExpr("CAST(1 AS BIGINT) AS graph_id", "k AS dependent_id", "p AS dependency_id")
    )


def order_chains(spark, sf_dir):
    """Each order waits for its customer's previous order; every fiftieth also for the order at half its key."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey + 1 AS k")
    chained = previous_value(orders, ["o_custkey"], ["k"], "k", "p").where("p IS NOT NULL")
    chained = chained.selectExpr("CAST(1 AS BIGINT) AS graph_id", "k AS dependent_id", "p AS dependency_id")
    halved = orders.where("k % 50 = 0").selectExpr("CAST(1 AS BIGINT) AS graph_id", "k AS dependent_id", "k div 2 AS dependency_id")
    return chained.unionByName(halved).distinct()


def frames(spark, sf_dir):
    """One frame per vector; velocities are the positions in reverse."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_id"),
        F.col("embedding").alias("positions"),
        F.reverse("embedding").alias("velocities"),
    )


def resources(spark, sf_dir):
    """One resource per document, dealt out over the frames."""
    n_frames = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)))
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % n_frames.scalar()).alias("frame_id"),
        F.col("doc_id").alias("idx"),
        F.col("n_chars").alias("size_bytes"),
    )
