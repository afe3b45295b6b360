"""Per-frame column work: move objects, total the uploads, cull, checksum, seal.

A frame is one row with its objects in float32 arrays, so each step is a projection and the
whole pipeline has a single shuffle, where the upload totals meet their frames.
"""

from pyspark.sql import functions as F

from depweave.functions.checksum import limbs_to_decimal, rolling_checksum, seal_frame
from depweave.schemas import FRAME_STEP_SECONDS


def _f32(value):
    return F.lit(float(value)).cast("float")


def init_frames(frames):
    """Reset everything that later stages derive."""
    zero, off = F.lit(0).cast("long"), F.lit(False)
    return frames.withColumns(
        {
            "visible": F.array().cast("array<float>"),
            "uploaded_bytes": zero,
            "render_checksum": zero.cast("decimal(20,0)"),
            "presented_checksum": zero.cast("decimal(20,0)"),
            "frame_prepared": F.lit(True),
            "simulation_updated": off,
            "resources_uploaded": off,
            "visibility_computed": off,
            "render_commands_built": off,
            "frame_presented": off,
        }
    )


def integrate(frames, dt=FRAME_STEP_SECONDS):
    """Move every object by its velocity for one time step, rounding to float32 each time."""

    def step(position, velocity):
        travelled = (velocity * _f32(dt)).cast("float")
        return (position + travelled).cast("float")

    moved = F.zip_with("positions", "velocities", step)
    return frames.withColumns({"positions": moved, "simulation_updated": F.lit(True)})


def upload_total(frames, resources):
    """Total resource bytes of every frame, 0 for a frame without resources."""
    totals = resources.groupBy("frame_id").agg(F.sum("size_bytes").alias("_total"))
    return (
        frames.drop("uploaded_bytes")
        .join(totals, "frame_id", "left")
        .withColumn("uploaded_bytes", F.coalesce("_total", F.lit(0)).cast("long"))
        .withColumn("resources_uploaded", F.lit(True))
        .drop("_total")
    )


def cull(frames, limit=1.0):
    """Keep the objects within the view limit (inclusive), in their order."""
    seen = F.filter("positions", lambda position: F.abs(position) <= _f32(limit))
    return frames.withColumns({"visible": seen, "visibility_computed": F.lit(True)})


def build_commands(frames):
    """Checksum of the visible objects, seeded with the uploaded bytes."""
    return frames.withColumns(
        {
            "_checksum": rolling_checksum(F.col("uploaded_bytes"), F.col("visible")),
            "render_commands_built": F.lit(True),
        }
    ).withColumn("render_checksum", limbs_to_decimal(F.col("_checksum")))


def present(frames):
    """Seal the checksum with the number of visible objects."""
    sealed = seal_frame(F.col("_checksum"), F.size("visible"))
    return (
        frames.withColumn("presented_checksum", limbs_to_decimal(sealed))
        .withColumn("frame_presented", F.lit(True))
        .drop("_checksum")
    )


def require_stage(df, cond, msg, mode="fail"):
    """Guard a stage: rows that do not meet ``cond`` fail the query, or with ``mode="flag"``
    carry ``msg`` in the column ``stage_error`` (the first broken guard is kept)."""
    if mode not in ("fail", "flag"):
        raise ValueError("mode is 'fail' or 'flag'")
    cond = F.expr(cond) if isinstance(cond, str) else cond
    broken = ~F.coalesce(cond, F.lit(False))
    if mode == "fail":
        return df.where(F.when(broken, F.raise_error(F.lit(msg)).cast("boolean")).otherwise(True))
    earlier = F.col("stage_error") if "stage_error" in df.columns else F.lit(None).cast("string")
    return df.withColumn("stage_error", F.coalesce(earlier, F.when(broken, F.lit(msg))))


# What each stage demands, and the text when it is missing.
STAGE_GUARDS = {
    "integrate": ("frame_prepared", "Frame must be prepared before updating the simulation"),
    "upload": ("frame_prepared", "Frame must be prepared before uploading resources"),
    "cull": ("simulation_updated", "Simulation must be updated before visibility culling"),
    "build": (
        "resources_uploaded AND visibility_computed",
        "Resources and visibility data are required to build render commands",
    ),
    "present": ("render_commands_built", "Render commands must be built before presenting the frame"),
}


def frame_pipeline(frames, resources, dt=FRAME_STEP_SECONDS, limit=1.0):
    """All stages as one lazy plan, each behind its guard."""

    def guard(df, stage):
        return require_stage(df, *STAGE_GUARDS[stage])

    ready = init_frames(frames)
    moved = integrate(guard(ready, "integrate"), dt)
    culled = cull(guard(moved, "cull"), limit)
    uploaded = upload_total(guard(culled, "upload"), resources)
    return present(guard(build_commands(guard(uploaded, "build")), "present"))
