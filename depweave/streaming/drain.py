"""Running a stream over what is there now, into a table in the shared folder."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.plans.scratch import Scratch

# State on executor disks instead of in their heaps, saved as changes only per batch.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def drain(stream, mode="append"):
    """Process all input present, then stop; returns a batch table of everything emitted.

    Each micro-batch is written under its number, so a batch that is run again replaces its
    own rows. The column ``batch`` tells later updates from earlier ones.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, "stream")
    # Fixes the folder's layout even if no batch has any rows.
    scratch.put(spark.createDataFrame([], stream.schema), "out/batch=-1")

    def write(rows, batch):
        rows.write.mode("overwrite").parquet(scratch.path(f"out/batch={batch}"))

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", scratch.path("progress"))
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return scratch.get("out", T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType(), True)]))


def latest(updates, keys):
    """The last emitted row of every key."""
    others = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}") for c in others])
