"""Calibration: position-wise joins of signals with master frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwise.functions.numerics import canonical_zero
from stackwise.schema import INVALID, count_of, eligible, finite, masked, non_finite, require

from .integrate import integrate_mean

NAN = float("nan")
SPOT = ("plane", "y", "x")


def _master(image: DataFrame, name: str) -> DataFrame:
    return image.select(*SPOT, F.col("value").alias(f"{name}_value"), F.coalesce("flags", F.lit(0)).cast("int").alias(f"{name}_flags"))


def _with(samples: DataFrame, master: DataFrame, name: str, small: bool) -> DataFrame:
    """Left join with a master; a position that it lacks is a shape mismatch, marked by null flags."""
    side = _master(master, name)
    return samples.join(F.broadcast(side) if small else side, list(SPOT), "left")


def shape_mismatches(samples: DataFrame, master: DataFrame) -> DataFrame:
    """Positions of the samples that the master lacks; must be empty before calibration."""
    return samples.select(*SPOT).distinct().join(master.select(*SPOT), list(SPOT), "left_anti")


def calibrate_dark_flat(signal: DataFrame, dark: DataFrame, flat: DataFrame, minimum_flat: float, small_masters: bool = False) -> DataFrame:
    """``(signal - dark) / flat`` for every sample.

    Any flag: NaN, with all flags.  Any non-finite input or ``|flat| <= minimum_flat``: NaN and INVALID.  A result that
    overflows is kept and INVALID.  ``small_masters`` is the caller's promise that one master fits an executor.
    """
    require(minimum_flat >= 0, "minimum_flat must not be negative")
    joined = _with(_with(signal, dark, "dark", small_masters), flat, "flat", small_masters)
    seen = F.coalesce("flags", F.lit(0)).cast("int").bitwiseOR(F.coalesce("dark_flags", F.lit(0))).bitwiseOR(F.coalesce("flat_flags", F.lit(0)))
    usable = finite(F.col("value")) & finite(F.col("dark_value")) & finite(F.col("flat_value"))
    good = usable & (F.abs("flat_value") > minimum_flat)
    result = canonical_zero(F.try_divide(F.col("value") - F.col("dark_value"), F.col("flat_value")))
    return _outcome(joined, seen, good, result, signal.columns)


def _outcome(joined: DataFrame, seen: Column, good: Column, result: Column, names: list[str]) -> DataFrame:
    invalid = seen.bitwiseOR(F.lit(INVALID))
    value = F.when((seen == 0) & good, result).otherwise(NAN)
    flags = F.when(seen != 0, seen).when(good & finite(result), 0).otherwise(invalid)
    return joined.withColumns({"value": value, "flags": flags.cast("short")}).select(*names)


def subtract_pedestal(signal: DataFrame, pedestal: DataFrame, small_masters: bool = False) -> DataFrame:
    """``signal - pedestal`` with the same rules for flags and non-finite values."""
    joined = _with(signal, pedestal, "dark", small_masters)
    seen = F.coalesce("flags", F.lit(0)).cast("int").bitwiseOR(F.coalesce("dark_flags", F.lit(0)))
    result = canonical_zero(F.col("value") - F.col("dark_value"))
    return _outcome(joined, seen, finite(F.col("value")) & finite(F.col("dark_value")), result, signal.columns)


def flat_support(flat: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Accounting and exact median of the clear, finite, positive samples of each flat."""
    positive = eligible() & (F.col("value") > 0)
    return flat.groupBy(*keys).agg(
        count_of(positive).alias("accepted"),
        count_of(masked()).alias("masked"),
        count_of(non_finite()).alias("non_finite"),
        count_of(eligible() & (F.col("value") <= 0)).alias("non_positive"),
        F.median(F.when(positive, F.col("value"))).alias("median"),
    )


def normalize_flat(flat: DataFrame, minimum_valid_samples: int = 1, minimum_median: float = 0.0, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Each flat divided by its median; ``failure`` says why a flat has no normalised values."""
    require(minimum_valid_samples >= 1 and minimum_median >= 0, "flat limits must be positive")
    support = flat_support(flat, keys)
    failure = F.when(F.col("accepted") < minimum_valid_samples, "insufficient_samples").when(F.col("median") <= minimum_median, "median_too_small")
    support = support.select(*keys, F.col("median").alias("_median"), failure.alias("failure"))
    joined = flat.join(support, list(keys))
    good = finite(F.col("value")) & (F.col("value") > 0) & F.col("failure").isNull()
    seen = F.coalesce("flags", F.lit(0)).cast("int")
    return _outcome(joined, seen, good, F.col("value") / F.col("_median"), [*flat.columns, "failure"])


def master(frames: DataFrame, kind: str, keys: tuple[str, ...] = ("stack_id", *SPOT)) -> DataFrame:
    """The strict mean of a set of bias, dark or (pedestal-corrected) flat frames, with its role."""
    require(kind in ("bias", "dark", "flat"), "kind must be bias, dark or flat")
    return integrate_mean(frames, keys).withColumn("kind", F.lit(kind))
