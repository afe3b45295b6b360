"""Connected components of a table of links, by rounds of hooking and shortcuts."""

from pyspark.sql import functions as F


def components(links, scratch, name):
    """(node, component) for every node of ``links`` (a, b); a component is its smallest node.

    In a round every component joins its smallest neighbour, the chains this makes are
    shortened to their ends, and links are taken over to the components. All components but local
    minima vanish in a round, so the rounds are at most the logarithm of the number of nodes.
    Nodes with many links meet them in partial aggregates and splittable joins.
    """
    links, seen = scratch.put(links.where("a <> b").select("a", "b"), f"{name}-links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = scratch.put(nodes.select("node", F.col("node").alias("component")), f"{name}-labels")[0]
    turn = 0
    while seen["rows"]:
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        hooks, _ = scratch.put(hooks.select("node", F.least("node", "low").alias("up")), f"{name}-hooks-{turn}")
        step, changed = 0, 1
        while changed:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            jumped, moved = scratch.put(jumped, f"{name}-hooks-{turn}-{step}", moved=F.count_if("moved"))
            hooks, changed, step = jumped.select("node", "up"), moved["moved"], step + 1
        at = hooks.select(F.col("node").alias("component"), "up")
        labels = labels.join(at, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = scratch.put(labels, f"{name}-labels-{turn}")[0]
        left = hooks.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = hooks.select(F.col("node").alias("b"), F.col("up").alias("y"))
        links = links.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        links, seen = scratch.put(links, f"{name}-links-{turn}")
        turn += 1
    return labels
