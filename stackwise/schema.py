"""The data model: samples of aligned frames, quality flags and parameter checks.

A *sample* is one value of one frame at one position: ``(stack_id, frame_id, plane, y, x, value, flags)``.  A sample takes
part in an estimate iff its flags are clear and its value is finite; masked goes before non-finite.  Null, NaN and
masked are three different things and stay so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quality flag bits.
MISSING, SATURATED, HOT, COLD, REJECTED, INVALID = 1, 2, 4, 8, 16, 32

#: Flags are SMALLINT, so that all bits of a byte survive.
SAMPLES = T.StructType(
    [
        T.StructField("stack_id", T.IntegerType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("plane", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("flags", T.ShortType()),
    ]
)
PIXEL = ("stack_id", "plane", "y", "x")
IMAGE = ("stack_id", "frame_id", "plane")


class ParameterError(ValueError):
    """A parameter outside of its domain."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ParameterError(message)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def clear(flags: Column) -> Column:
    return F.coalesce(flags, F.lit(0)) == 0


def eligible(value: Column | None = None, flags: Column | None = None) -> Column:
    value = F.col("value") if value is None else value
    flags = F.col("flags") if flags is None else flags
    return clear(flags) & finite(value)


def masked(flags: Column | None = None) -> Column:
    return ~clear(F.col("flags") if flags is None else flags)


def non_finite(value: Column | None = None, flags: Column | None = None) -> Column:
    value = F.col("value") if value is None else value
    flags = F.col("flags") if flags is None else flags
    return clear(flags) & ~finite(value)


def count_of(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def or_flags(flags: Column | None = None) -> Column:
    return F.bit_or(F.coalesce(F.col("flags") if flags is None else flags, F.lit(0)).cast("int"))


def unsupported_flags(flags: Column, has_non_finite: Column) -> Column:
    """Flags of a position without support: all that was seen, MISSING, and INVALID after an unmasked non-finite."""
    out = flags.cast("int").bitwiseOR(F.lit(MISSING))
    return F.when(has_non_finite, out.bitwiseOR(F.lit(INVALID))).otherwise(out).cast("short")
