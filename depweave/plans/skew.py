"""Ordered work inside groups of any size.

A window over ``partitionBy(key)`` puts a whole key into one task, which stops working when
one key holds a third of the table. Here a key above the ``hotRows`` limit is cut into slices
by a range partitioning on its order columns. Each slice is an ordinary bounded window, and
what earlier slices contribute is added from a table with one row per slice.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from depweave.plans.limits import limit
from depweave.plans.scratch import Scratch

SLICE = "_slice"
BUCKETS = 1 << 20


def key_join(left, right, keys, how="inner"):
    """Join on null-safe equality of ``keys``; the result has the keys once, from the left."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    on = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{key}" for key in keys])


def keys_above(df, keys, rows):
    """The keys with more than ``rows`` rows, as a written table; None if there are none.

    Rows are first counted per hash bucket, so a map task sends a bounded number of counts
    however many keys there are. Keys are counted exactly only inside overfull buckets.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    buckets = df.select(bucket).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    if (buckets.agg(F.max("n")).first()[0] or 0) <= rows:
        return None
    scratch = Scratch(df.sparkSession, "hot")
    full = scratch.put(buckets.where(F.col("n") > rows).select("_bucket"), "buckets")[0]
    suspects = df.select(*keys, bucket).join(sized_broadcast(full), "_bucket", "left_semi")
    sizes = suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot, seen = scratch.put(sizes.where(F.col("n") > rows).select(*keys), "keys")
    return hot if seen["rows"] else None


def attach(df, lookup, keys, sized_by=None):
    """Left join of a table with one row per key, for keys of any size in ``df``.

    NULL keys find nothing, whatever the lookup holds. The few keys above the limit take their lookup row by broadcast; at most one row in
    ``hotRows`` is such a key. ``sized_by`` is a cheaper table with the same rows per key.
    """
    hot = keys_above((df if sized_by is None else sized_by).select(*keys), keys, limit(df.sparkSession, "hotRows"))
    if hot is None:
        return df.join(lookup, keys, "left")
    hot = sized_broadcast(hot)
    few = sized_broadcast(lookup.join(hot, keys, "left_semi"))
    cold = key_join(df, hot, keys, "left_anti").join(lookup, keys, "left")
    return cold.unionByName(key_join(df, hot, keys, "left_semi").join(few, keys, "left"))


def sized_broadcast(lookup):
    """Broadcast ``lookup`` when it was counted to be small, else leave the join to Spark."""
    allowed = limit(lookup.sparkSession, "broadcastRows")
    small = lookup.limit(allowed + 1).count() <= allowed
    return F.broadcast(lookup) if small else lookup


def _slices(df, keys, order):
    """Cold rows with slice 0, and hot rows in ordered slices (None if no key is hot)."""
    spark = df.sparkSession
    most = limit(spark, "hotRows")
    hot_keys = keys_above(df.select(*keys), keys, most)
    if hot_keys is None:
        return df.withColumn(SLICE, F.lit(0)), None
    hot_keys = sized_broadcast(hot_keys)
    cold = key_join(df, hot_keys, keys, "left_anti").withColumn(SLICE, F.lit(0))
    hot = key_join(df, hot_keys, keys, "left_semi")
    wanted = hot.count() // most * 2 + 2
    cut = hot.repartitionByRange(wanted, *keys, *order).withColumn(SLICE, F.spark_partition_id() + 1)
    # Written once: range bounds come from a sample and must not be drawn a second time.
    return cold, Scratch(spark, "slices").put(cut, "rows")[0]


def running_totals(df, keys, order, known_rows=None, **totals):
    """Add inclusive running totals per key along ``order``, which must be a total order.

    ``totals`` maps new column names to the columns to sum; ``F.lit(1)`` gives a rank.
    ``known_rows`` is a row count the caller already has; when it is within the limit no
    counting job is needed.
    """
    window = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    values = {name: column.cast("long") for name, column in totals.items()}
    if known_rows is not None and known_rows <= limit(df.sparkSession, "hotRows"):
        cold, hot = df.withColumn(SLICE, F.lit(0)), None
    else:
        cold, hot = _slices(df, keys, order)

    def within_slices(rows):
        return rows.withColumns({name: F.sum(value).over(window) for name, value in values.items()})

    if hot is None:
        return within_slices(cold).drop(SLICE)
    # One row per (hot key, slice): at most the number of hot keys plus the number of slices.
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        hot.groupBy(*keys, SLICE)
        .agg(*[F.sum(value).alias(name) for name, value in values.items()])
        .select(
            *keys,
            SLICE,
            *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in values],
        )
    )
    shifted = key_join(within_slices(hot), sized_broadcast(carried), [*keys, SLICE]).select(
        *df.columns,
        *[(F.col(name) + F.col(f"_before_{name}")).alias(name) for name in values],
    )
    return within_slices(cold).drop(SLICE).unionByName(shifted)


def previous_value(df, keys, order, value, name):
    """Add ``value`` of the preceding row of the same key along ``order``, NULL for the first."""
    window = Window.partitionBy(*keys, SLICE).orderBy(*order)
    cold, hot = _slices(df, keys, order)
    inside = cold.withColumn(name, F.lag(value).over(window)).drop(SLICE)
    if hot is None:
        return inside
    lasts = hot.groupBy(*keys, SLICE).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    lasts = lasts.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(SLICE)))
    lasts = sized_broadcast(lasts.select(*keys, SLICE, "_carry"))
    marked = hot.withColumns({"_in": F.lag(value).over(window), "_row": F.row_number().over(window)})
    carried = F.when(F.col("_row") == 1, F.col("_carry")).otherwise(F.col("_in"))
    joined = key_join(marked, lasts, [*keys, SLICE])
    return inside.unionByName(joined.select(*df.columns, carried.alias(name)))
