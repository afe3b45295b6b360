"""The frame steps over long tables, one row per object: (frame_id, idx, position, velocity).

Frames of any size work here. Moving and culling are row-wise; the checksum depends on the
order of all objects of a frame, so a frame too large for one array is folded stretch by
stretch, with the checksum so far carried from one written round to the next.
"""

from pyspark.sql import functions as F

from depweave.functions.checksum import continue_checksum, limbs, limbs_to_decimal, seal_frame
from depweave.plans.limits import limit
from depweave.plans.scratch import Scratch
from depweave.plans.skew import key_join, keys_above, running_totals, sized_broadcast
from depweave.schemas import FRAME_STEP_SECONDS

FRAME = ["frame_id"]


def integrate_objects(objects, dt=FRAME_STEP_SECONDS):
    """Move every object by its velocity for one time step, rounding to float32 each time."""
    travelled = (F.col("velocity") * F.lit(float(dt)).cast("float")).cast("float")
    return objects.withColumn("position", (F.col("position") + travelled).cast("float"))


def cull_objects(objects, limit=1.0):
    """Keep the objects within the view limit (inclusive)."""
    return objects.where(F.abs("position") <= F.lit(float(limit)).cast("float"))


def checksum_objects(objects, seeds):
    """Checksum and number of objects of every frame in ``seeds`` (frame_id, seed)."""
    spark = objects.sparkSession
    most = limit(spark, "listEntries")
    rows = objects.select("frame_id", "idx", "position")
    states = seeds.select("frame_id", limbs(F.col("seed")).alias("sum"), F.lit(0).cast("long").alias("n"))
    large = keys_above(rows, FRAME, most)
    if large is None:
        return _finish(_fold_stretch(states, _listed(rows, FRAME)))
    scratch = Scratch(spark, "checksum")
    large = sized_broadcast(large)
    small = _fold_stretch(
        key_join(states, large, FRAME, "left_anti"), _listed(key_join(rows, large, FRAME, "left_anti"), FRAME)
    )
    ranked = running_totals(key_join(rows, large, FRAME, "left_semi"), FRAME, ["idx"], rank=F.lit(1))
    stretches = _listed(ranked.withColumn("stretch", F.expr(f"(rank - 1) div {most}")), [*FRAME, "stretch"])
    stretches, seen = scratch.put(stretches, "stretches", partition_by=["stretch"], last=F.max("stretch"))
    carried = key_join(states, large, FRAME, "left_semi")
    for turn in range(seen["last"] + 1):
        part = stretches.where(F.col("stretch") == turn).drop("stretch")
        carried = scratch.put(_fold_stretch(carried, part), f"sums-{turn}")[0]
    return _finish(small.unionByName(carried))


def _listed(rows, keys):
    ordered = F.sort_array(F.collect_list(F.struct("idx", "position")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["position"]).alias("positions"))


def _fold_stretch(states, lists):
    found = F.coalesce("positions", F.array().cast("array<float>"))
    return states.join(lists, FRAME, "left").select(
        "frame_id", continue_checksum(F.col("sum"), found).alias("sum"), (F.col("n") + F.size(found)).alias("n")
    )


def _finish(states):
    return states.select(
        "frame_id",
        F.col("n").alias("n_visible"),
        limbs_to_decimal(F.col("sum")).alias("render_checksum"),
        limbs_to_decimal(seal_frame(F.col("sum"), F.col("n"))).alias("presented_checksum"),
    )


def object_pipeline(frames, objects, resources, dt=FRAME_STEP_SECONDS, limit=1.0):
    """The whole frame pipeline over long tables: one row per frame of ``frames``."""
    totals = resources.groupBy("frame_id").agg(F.sum("size_bytes").alias("bytes"))
    uploads = frames.select("frame_id").join(totals, "frame_id", "left")
    uploads = uploads.select("frame_id", F.coalesce("bytes", F.lit(0)).cast("long").alias("uploaded_bytes"))
    visible = cull_objects(integrate_objects(objects, dt), limit)
    sums = checksum_objects(visible, uploads.withColumnRenamed("uploaded_bytes", "seed"))
    return uploads.join(sums, "frame_id")
