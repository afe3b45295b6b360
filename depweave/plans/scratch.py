"""Intermediate tables in the cluster's shared checkpoint folder.

A driver loop has to cut its lineage every round. Each round is written once as a parquet
table, which survives the loss of any executor, keeps column pruning, and carries real file
sizes so that Spark can choose a broadcast join by measured size. Tables of numbers are written plain for that:
sorted ids encode and compress to a small part of what the driver would hold of them to broadcast them. Row counts ride
along on the write as observed metrics, so a round is one job.
"""

import tempfile
import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Files of these columns alone are as large as the rows are in memory.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def shared_folder(spark):
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="depweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """A private subfolder of the shared folder, holding the tables of one operator call.

    Results are lazy and may read these tables at any later time, so they stay until the
    application's folder is removed.
    """

    def __init__(self, spark, label):
        self.spark = spark
        application = spark.sparkContext.applicationId
        self.root = f"{shared_folder(spark)}/depweave-{application}/{label}-{uuid.uuid4().hex}"

    def put(self, df, name, partition_by=(), **metrics):
        """Write ``df`` and return the written table with its observed metrics.

        ``rows`` is always among the metrics. They are taken directly below the write, in
        the result stage, where a retried task is counted once.
        """
        seen = Observation()
        counted = df.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            *[F.coalesce(expr, F.lit(0)).cast("long").alias(key) for key, expr in metrics.items()],
        )
        plain = PLAIN if all(isinstance(field.dataType, FIXED_WIDTH) for field in df.schema) else {}
        counted.write.mode("overwrite").options(**plain).partitionBy(*partition_by).parquet(self.path(name))
        return self.get(name, df.schema), seen.get

    def get(self, name, schema):
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name):
        """Remove a table that a later round has replaced."""
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

    def path(self, name):
        return f"{self.root}/{name}"
