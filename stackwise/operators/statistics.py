"""Image statistics: counts, extremes, mean and variances of the usable samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwise.schema import IMAGE, count_of, eligible, masked, non_finite


def image_statistics(samples: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """One row per image, in two aggregations: extremes and scale, then moments of the scaled, centred samples.

    Centring on the image's own middle keeps the second moment free of cancellation without ordering the samples, so the
    partial sums merge on any partitioning.
    """
    value = F.when(eligible(), F.col("value"))
    first = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        count_of(eligible()).alias("usable"),
        count_of(masked()).alias("masked"),
        count_of(non_finite()).alias("non_finite"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    )
    middle = F.col("minimum") / 2 + F.col("maximum") / 2
    half = F.col("maximum") / 2 - F.col("minimum") / 2
    first = first.withColumns({"_middle": middle, "_half": F.when(half == 0, 1.0).otherwise(half)})
    ref = first.select(*[F.col(k).alias(f"_{k}") for k in keys], "_middle", "_half")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    unit = (F.col("value") - F.col("_middle")) / F.col("_half")
    second = (
        samples.filter(eligible()).join(ref, condition).select(*keys, unit.alias("u"))
        .groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
        .agg(F.avg("u").alias("_m1"), F.var_pop("u").alias("_pop"), F.var_samp("u").alias("_samp"))
    )
    out = first.join(second, condition, "left")
    scale = F.col("_half") * F.col("_half")
    return out.select(
        *keys, "total", "usable", "masked", "non_finite", "minimum", "maximum",
        (F.col("_middle") + F.col("_half") * F.col("_m1")).alias("mean"),
        (F.col("_pop") * scale).alias("population_variance"),
        F.when(F.col("usable") > 1, F.col("_samp") * scale).alias("sample_variance"),
    )


def inventory(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each value of each of some columns: (field, value, n).  One pass, one grouping set per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return frames.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
