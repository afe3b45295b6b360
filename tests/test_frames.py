import random
import struct

import pytest
from model import rows
from pyspark.sql import functions as F

from depweave.functions.checksum import limbs_to_decimal, rolling_checksum, seal_frame
from depweave.operators import frames as ops
from depweave.operators import objects

POSITIONS = [-1.4, -0.7, -0.1, 0.35, 0.9, 1.3]
VELOCITIES = [0.8, 0.2, -0.1, 0.4, -0.3, -0.6]
SIZES = [4096, 16384, 8192, 2048]
FRAME = "frame_id long, positions array<float>, velocities array<float>"


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def checksum(seed, xs):
    for x in xs:
        seed = seed * 1099511628211 % 2**64 ^ int(f32(f32(f32(x) + 2.0) * 1000.0)) % 2**64
    return seed


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(1, POSITIONS, VELOCITIES)], FRAME)


@pytest.fixture
def resources(spark):
    return spark.createDataFrame([(1, i, size) for i, size in enumerate(SIZES)], "frame_id long, idx long, size_bytes long")


def test_whole_pipeline_on_the_sample_frame(frame, resources):
    done = ops.frame_pipeline(frame, resources)
    assert rows(done, F.size("visible"), "uploaded_bytes", "render_checksum", "presented_checksum", "frame_presented") == [
        (4, 30720, 9779669404232385364, 9779669421412254548, True)
    ]


def test_positions_move_in_float32(frame):
    moved = ops.integrate(frame).first().positions
    assert moved == [f32(f32(x) + f32(f32(v) * f32(1 / 60))) for x, v in zip(POSITIONS, VELOCITIES)]


def test_the_view_limit_is_inclusive_and_order_is_kept(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 1.5, -0.25, 2.0], None)], FRAME)
    assert ops.cull(df).first().visible == [1.0, -1.0, -0.25]


def test_checksum_wraps_like_unsigned_64_bit(spark):
    rng = random.Random(9)
    data = [(i, rng.randrange(2**63), [rng.uniform(-5, 5) for _ in range(i)]) for i in range(40)]
    df = spark.createDataFrame(data, "i long, seed long, xs array<float>")
    total = rolling_checksum(F.col("seed"), F.col("xs"))
    found = rows(df.select("i", limbs_to_decimal(total), limbs_to_decimal(seal_frame(total, F.size("xs")))))
    assert found == [(i, checksum(seed, xs), checksum(seed, xs) ^ (len(xs) << 32)) for i, seed, xs in data]


def test_frames_without_resources_upload_nothing(frame, resources):
    empty = resources.where("false")
    assert rows(ops.upload_total(frame, empty), "uploaded_bytes") == [(0,)]


def test_init_resets_derived_columns(frame, resources):
    again = ops.init_frames(ops.frame_pipeline(frame, resources)).first()
    assert (again.visible, again.uploaded_bytes, again.presented_checksum) == ([], 0, 0)
    assert again.frame_prepared and not again.simulation_updated and not again.frame_presented


@pytest.mark.parametrize("stage", ops.STAGE_GUARDS)
def test_guards_stop_or_flag_rows_that_come_too_early(frame, stage):
    condition, message = ops.STAGE_GUARDS[stage]
    early = ops.init_frames(frame).withColumns({"frame_prepared": F.lit(False)})
    flagged = ops.require_stage(early, condition, message, mode="flag")
    assert rows(flagged, "stage_error") == [(message,)]
    assert rows(ops.require_stage(flagged, "false", "later", mode="flag"), "stage_error") == [(message,)]
    with pytest.raises(Exception, match=message):
        ops.require_stage(early, condition, message).collect()


@pytest.mark.parametrize("most", [None, 3])
def test_long_frames_give_the_same_checksums(spark, limits, most):
    rng = random.Random(1)
    frames = [(i, [rng.uniform(-2, 2) for _ in range(n)], [rng.uniform(-1, 1) for _ in range(n)]) for i, n in enumerate([0, 1, 3, 4, 11, 20])]
    df = spark.createDataFrame(frames, FRAME)
    sizes = spark.createDataFrame([(4, 0, 99), (4, 1, 2**40), (5, 0, 7)], "frame_id long, idx long, size_bytes long")
    rows_of = [(i, k, xs[k], vs[k]) for i, xs, vs in frames for k in range(len(xs))]
    long = spark.createDataFrame(rows_of, "frame_id long, idx long, position float, velocity float").repartition(3)
    columns = ["frame_id", "uploaded_bytes", "render_checksum", "presented_checksum"]
    expected = rows(ops.frame_pipeline(df, sizes), *columns, F.size("visible").alias("n_visible"))
    with limits(**({"listEntries": most, "hotRows": 6} if most else {})):
        assert rows(objects.object_pipeline(df, long, sizes), *columns, "n_visible") == expected
