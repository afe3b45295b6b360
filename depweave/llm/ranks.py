"""Ranks inside groups of any size, without a window over a whole group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from depweave.plans.skew import key_join

ROW_BITS = 33


def ranked(df, keys, order, scratch, name, keep):
    """Columns ``keep`` (the keys among them) and ``rank``, from 0, of each row among the rows of its keys.

    All rows are sorted by one range partitioning on keys and ``order`` together, so a large group lies in
    many partitions, and written once. The rank is the place inside the partition plus the
    rows of the group in earlier partitions, which come from one row per group and partition. NULL
    keys form a group. ``order`` should tell different rows apart; equal rows may change places.
    """
    by = [F.col(key).asc_nulls_first() for key in keys] + list(order)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = scratch.put(placed.select(*keep, F.monotonically_increasing_id().alias("_at")), name)[0]
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", ROW_BITS))
    parts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")
    joined = key_join(placed, parts.select(*keys, "_part", before.alias("_shift")), [*keys, "_part"])
    return joined.select(*keep, (F.col("_at") + F.col("_shift")).alias("rank"))
