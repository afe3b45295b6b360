"""Two ways through per-graph iteration, chosen by counted graph sizes.

Graphs within the ``graphRows`` limit are dealt into packs of bounded size and each pack is
one grouped Arrow task, so a million small graphs need one shuffle and no driver rounds.
Larger graphs go through driver rounds of joins that spread over the cluster.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depweave.plans.limits import limit
from depweave.plans.scratch import Scratch
from depweave.plans.skew import sized_broadcast

PACK = "_pack"
# Shuffle partitions of a packed step; beyond that, a task takes several packs in turn.
MOST_PARTITIONS = 20_000


def graph_sizes(*tables):
    """Rows per graph over all ``tables``."""
    rows = tables[0].select("graph_id")
    for other in tables[1:]:
        rows = rows.unionAll(other.select("graph_id"))
    return rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("weight"))


class Tiers:
    """Splits tables by the size of the graph their rows belong to."""

    def __init__(self, weights, keys=("graph_id",), limit_name="graphRows", plan=None):
        """``weights`` has one row per group: its keys and the rows one task would hold.

        With ``plan="rounds"`` every group counts as large.
        """
        spark = weights.sparkSession
        self.keys = list(keys)
        self.most = most = 0 if plan == "rounds" else limit(spark, limit_name)
        small = F.col("weight") <= most
        summary = weights.agg(
            F.coalesce(F.sum(F.when(small, F.col("weight"))), F.lit(0)).alias("small_rows"),
            F.coalesce(F.count_if(~small), F.lit(0)).alias("n_large"),
        ).first()
        self.any_small = summary.small_rows > 0
        self.any_large = summary.n_large > 0
        rows = limit(spark, "packRows")
        self.packs = max(
            -(-summary.small_rows // rows),
            min(spark.sparkContext.defaultParallelism, -(-summary.small_rows // (rows // 25 + 1))),
            1,
        )
        if self.any_large:
            large = Scratch(spark, "large").put(weights.where(~small).select(*keys), "groups")[0]
            self._large = sized_broadcast(large)

    def small(self, df):
        """Rows of the groups that fit one task."""
        return df.join(self._large, self.keys, "left_anti") if self.any_large else df

    def large(self, df):
        """Rows of the graphs that do not."""
        return df.join(self._large, self.keys, "left_semi") if self.any_large else df.where(F.lit(False))

    def run(self, kernel, schema, *tables):
        """Apply ``kernel`` to every pack of groups, given each table as numpy columns."""
        pack = F.pmod(F.xxhash64(*self.keys), F.lit(self.packs)).cast("int")
        return packed(kernel, schema, self.packs, *[table.withColumn(PACK, pack) for table in tables])


def packed(kernel, schema, packs, *tables):
    """Group one table by pack, or cogroup two, and run ``kernel`` on plain numpy columns.

    ``packs`` is the number of packs where they are numbered; None lets Spark deal them out by hash.
    """
    names, expected = schema.fieldNames(), [table.columns for table in tables]

    def apply(*parts):
        result = kernel(*[columns(part, wanted) for part, wanted in zip(parts, expected)])
        return pa.table([result[name] for name in names], names=names)

    # Placed by pack number: balanced, and not merged into few tasks for being few bytes.
    placed = [table.repartitionById(min(packs, MOST_PARTITIONS), PACK) if packs else table for table in tables]
    # Fresh column identities, as both tables may stem from the same one.
    grouped = [table.select([F.col(c).alias(c) for c in table.columns]).groupBy(PACK) for table in placed]
    if len(grouped) == 1:
        return grouped[0].applyInArrow(lambda part: apply(part), schema)
    return grouped[0].cogroup(grouped[1]).applyInArrow(lambda left, right: apply(left, right), schema)


def columns(table, wanted):
    """Numpy columns by name; a side without rows in a pack arrives without columns."""
    if not table.num_rows:
        return {name: np.empty(0, dtype=np.int64) for name in wanted if name != PACK}
    return {name: table.column(name).to_numpy() for name in wanted if name != PACK}


def nullable(values, missing):
    """A LONG Arrow column with NULL where ``missing``."""
    return pa.array(np.asarray(values, dtype=np.int64), mask=np.asarray(missing))
