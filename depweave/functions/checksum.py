"""Order-sensitive unsigned 64-bit checksum over an array column.

Spark has no unsigned 64-bit type and its LONG arithmetic rejects overflow, so the running
value is held as two 32-bit limbs in LONG columns. The multiplier is 256 * 2^32 + 435.
"""

from pyspark.sql import functions as F

from depweave.schemas import CHECKSUM_MULTIPLIER

LOW_HALF = 0xFFFFFFFF
LIMB = 1 << 32
FACTOR_HIGH, FACTOR_LOW = divmod(CHECKSUM_MULTIPLIER, LIMB)


def _low(value):
    return value.bitwiseAND(F.lit(LOW_HALF))


def _high(value):
    return F.shiftrightunsigned(value, 32)


def limbs(value):
    """Split a LONG, read as an unsigned 64-bit value, into its two halves."""
    value = value.cast("long")
    return F.struct(_high(value).alias("hi"), _low(value).alias("lo"))


def limbs_to_decimal(pair):
    """The unsigned value of two limbs as DECIMAL(20,0)."""
    wide = "decimal(20,0)"
    return (pair["hi"].cast(wide) * F.lit(LIMB).cast(wide) + pair["lo"].cast(wide)).cast(wide)


def quantise(position):
    """Position shifted by two and scaled to thousandths in float32, cut towards zero."""
    shifted = (position.cast("float") + F.lit(2.0).cast("float")).cast("float")
    return (shifted * F.lit(1000.0).cast("float")).cast("float").cast("long")


def _fold(state, position):
    value = quantise(position)
    scaled = state["lo"] * FACTOR_LOW
    high = _low(state["hi"] * FACTOR_LOW + state["lo"] * FACTOR_HIGH + _high(scaled))
    return F.struct(
        high.bitwiseXOR(_high(value)).alias("hi"),
        _low(scaled).bitwiseXOR(_low(value)).alias("lo"),
    )


def continue_checksum(pair, positions):
    """Fold ``positions`` in array order into a checksum held as two limbs."""
    return F.aggregate(positions, pair, _fold)


def rolling_checksum(seed, positions):
    """Fold ``positions`` in array order into ``seed``; two limbs, see `limbs_to_decimal`."""
    return continue_checksum(limbs(seed), positions)


def seal_frame(checksum, visible_count):
    """Mix the number of visible objects into the high half of a checksum."""
    return F.struct(
        checksum["hi"].bitwiseXOR(_low(visible_count.cast("long"))).alias("hi"),
        checksum["lo"].alias("lo"),
    )
