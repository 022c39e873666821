"""Previews: reduced images, automatic display transforms and rendering to bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwise.functions.numerics import neumaier_sum
from stackwise.schema import IMAGE, count_of, eligible, or_flags, require

# The automatic stretch.
MAD_SCALE, SHADOW_SIGMA, HIGH_QUANTILE, TARGET, EDGE = 1.4826, 2.8, 0.9995, 0.25, 1e-6


def reduction_level(width: int, height: int, maximum_width: int, maximum_height: int) -> int:
    """The finest halving that fits."""
    require(min(width, height, maximum_width, maximum_height) > 0, "sizes must be positive")
    for level in range(16):
        if -(-width >> level) <= maximum_width and -(-height >> level) <= maximum_height:
            return level
    raise ValueError("no reduction fits")


def _blocks(samples: DataFrame, level: int):
    f = 1 << level
    keys = [*IMAGE, F.floor(F.col("y") / f).cast("int").alias("y"), F.floor(F.col("x") / f).cast("int").alias("x")]
    return samples.groupBy(*keys)


def block_preview(samples: DataFrame, level: int) -> DataFrame:
    """Block means with valid and excluded counts and the union of flags."""
    found = _blocks(samples, level).agg(
        F.sort_array(F.collect_list(F.when(eligible(), F.col("value")))).alias("values"),
        count_of(eligible()).alias("valid"), count_of(~eligible()).alias("excluded"), or_flags().cast("short").alias("flags"),
    )
    value = F.when(F.col("valid") > 0, neumaier_sum(F.transform("values", lambda v: v / F.col("valid"))))
    return found.select(*IMAGE, "y", "x", value.alias("value"), "valid", "excluded", "flags")


def bitmask_preview(samples: DataFrame, level: int, allowed: int) -> DataFrame:
    """Bitwise union of a categorical map; bits that aren't allowed make their sample invalid."""
    bits = F.col("value").try_cast("long")
    fine = eligible() & F.coalesce(F.col("value") == bits, F.lit(False)) & F.coalesce(bits.bitwiseAND(F.lit(~allowed)) == 0, F.lit(False))
    return _blocks(samples, level).agg(F.bit_or(F.when(fine, bits)).alias("value"), count_of(fine).alias("valid"), count_of(~fine).alias("excluded"))


def solve_midtone(background: Column, target: float = TARGET) -> Column:
    return background * (1 - target) / (background + target - 2 * background * target)


def display_transform(preview: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Black point, white point and midtone of each preview.

    A preview has bounded size.  Quantiles are exact aggregations: the median, the median deviation, and one element of
    the order at ``floor((n - 1) * HIGH_QUANTILE)``, which is a discrete quantile of that index.
    """
    keys = list(keys)
    good = preview.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    mid = good.groupBy(*keys).agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("samples"), F.sort_array(F.collect_list("value")).alias("_v"))
    mid = mid.withColumn("high_quantile", F.get("_v", F.floor((F.col("samples") - 1) * HIGH_QUANTILE).cast("int"))).drop("_v")
    mad = good.join(mid.select(*keys, "median"), keys).groupBy(*keys).agg((F.median(F.abs(F.col("value") - F.col("median"))) * MAD_SCALE).alias("scaled_mad"))
    out = mid.join(mad, keys)
    fallback = F.greatest(F.abs("median"), F.lit(1.0)) * 1e-6
    out = out.withColumn("black", F.when(F.col("scaled_mad") > 0, F.col("median") - SHADOW_SIGMA * F.col("scaled_mad")).otherwise(F.col("median") - fallback))
    narrow = (F.col("high_quantile") <= F.col("black")) | (F.col("high_quantile") <= F.col("median"))
    out = out.withColumn("white", F.when(narrow, F.col("median") + fallback).otherwise(F.col("high_quantile")))
    background = F.least(F.greatest((F.col("median") - F.col("black")) / (F.col("white") - F.col("black")), F.lit(EDGE)), F.lit(1 - EDGE))
    return out.withColumn("midtone", solve_midtone(background))


def transfer(value: Column, kind: str = "midtones", midtone: Column | None = None, softness: float = 0.1) -> Column:
    """A value in [0, 1] after a linear, midtones or asinh curve."""
    if kind == "midtones":
        m = midtone
        value = F.when((value <= 0) | (value >= 1), value).otherwise((m - 1) * value / ((2 * m - 1) * value - m))
    elif kind == "asinh":
        value = F.asinh(value / softness) / F.asinh(F.lit(1 / softness))
    else:
        require(kind == "linear", "unknown transfer")
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def level(value: Column) -> Column:
    """0 to 255, half up."""
    return F.floor(value * 255 + 0.5).cast("int")


def render_grayscale(preview: DataFrame, transforms: DataFrame, kind: str = "midtones", keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """``r, g, b, a`` of each position; missing ones are transparent."""
    joined = preview.join(transforms.select(*keys, "black", "white", "midtone"), list(keys))
    there = F.col("value").isNotNull()
    g = F.when(there, level(transfer((F.col("value") - F.col("black")) / (F.col("white") - F.col("black")), kind, F.col("midtone")))).otherwise(0)
    return joined.select(*keys, "y", "x", g.alias("r"), g.alias("g"), g.alias("b"), F.when(there, 255).otherwise(0).alias("a"))


# Five anchors of the false-colour palette, and the colours of clear, hot, cold and both.
PALETTE = ((0, 0, 4), (87, 16, 110), (188, 55, 84), (249, 142, 9), (252, 255, 164))
DEFECT_COLOURS = {0: (0, 0, 0, 0), 4: (255, 64, 64, 255), 8: (64, 128, 255, 255), 12: (255, 64, 255, 255)}


def render_false_color(preview: DataFrame, transforms: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Linear interpolation between palette anchors; 0 is transparent."""
    joined = preview.join(transforms.select(*keys, "black", "white"), list(keys))
    t = transfer((F.col("value") - F.col("black")) / (F.col("white") - F.col("black")), "linear") * (len(PALETTE) - 1)
    at = F.least(F.floor(t), F.lit(len(PALETTE) - 2)).cast("int")
    shown = F.col("value").isNotNull() & (F.col("value") != 0)

    def channel(k: int) -> Column:
        stops = F.array(*[F.lit(float(c[k])) for c in PALETTE])
        low, high = F.get(stops, at), F.get(stops, at + 1)
        return F.when(shown, F.floor(low + (high - low) * (t - at) + 0.5).cast("int")).otherwise(0)

    return joined.select(*keys, "y", "x", *[channel(k).alias(n) for k, n in enumerate("rgb")], F.when(shown, 255).otherwise(0).alias("a"))


def render_defects(preview: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Categorical colours of a reduced defect map."""
    def channel(k: int) -> Column:
        out = F.lit(0)
        for bits, colour in DEFECT_COLOURS.items():
            out = F.when(F.col("value").bitwiseAND(F.lit(12)) == bits, colour[k]).otherwise(out)
        return out

    return preview.select(*keys, "y", "x", *[channel(k).alias(n) for k, n in enumerate("rgba")])


def render_rgb(planes: DataFrame, black: float, white: float, midtone: float) -> DataFrame:
    """Linked colours from planes 0, 1 and 2; a position that lacks one is transparent."""
    keys = ["stack_id", "frame_id", "y", "x"]
    wide = planes.groupBy(*keys).agg(*[F.max(F.when(F.col("plane") == p, F.col("value"))).alias(f"c{p}") for p in range(3)])
    there = F.col("c0").isNotNull() & F.col("c1").isNotNull() & F.col("c2").isNotNull()
    shade = lambda p: F.when(there, level(transfer((F.col(f"c{p}") - black) / (white - black), "midtones", F.lit(midtone)))).otherwise(0)
    return wide.select(*keys, *[shade(p).alias(n) for p, n in enumerate("rgb")], F.when(there, 255).otherwise(0).alias("a"))


def rejection_histogram(integrated: DataFrame) -> DataFrame:
    """How many positions had how many rejections."""
    return integrated.groupBy("stack_id", (F.col("low_rejected") + F.col("high_rejected")).alias("rejected")).agg(F.count(F.lit(1)).alias("positions"))


def inspect_position(products: dict[str, DataFrame], stack_id: int, plane: int, y: int, x: int) -> DataFrame:
    """Values of several products at one position: (product, value, flags); a filter that reaches each scan."""
    out = None
    for name, df in products.items():
        row = df.filter((F.col("stack_id") == stack_id) & (F.col("plane") == plane) & (F.col("y") == y) & (F.col("x") == x))
        row = row.select(F.lit(name).alias("product"), "value", "flags")
        out = row if out is None else out.unionByName(row)
    return out
