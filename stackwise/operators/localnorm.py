"""Local normalisation: robust affine fits in cells of a grid, and a surface of their coefficients."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.schema import INVALID, MISSING, REJECTED, clear, count_of, finite, require

KEYS = ("stack_id", "frame_id", "plane")


@dataclass(frozen=True)
class Grid:
    cell_width: int = 128
    cell_height: int = 128
    maximum_samples: int = 1024

    def __post_init__(self) -> None:
        require(self.cell_width >= 1 and self.cell_height >= 1, "cells need a positive size")
        require(2 <= self.maximum_samples <= 1414, "more than 1414 samples give over a million pairs")


@F.pandas_udf(T.LongType())
def coordinate_priority(y: pd.Series, x: pd.Series) -> pd.Series:
    """A well-mixed 64-bit hash of a position, less 2**63: the order of the longs is that of the unsigned hashes."""
    v = x.to_numpy().astype(np.uint64)
    w = y.to_numpy().astype(np.uint64)
    v = v ^ ((w << np.uint64(32)) | (w >> np.uint64(32))) ^ np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    v = v ^ (v >> np.uint64(31))
    return pd.Series((v ^ np.uint64(1 << 63)).view(np.int64))


def pair_frames(source: DataFrame, reference: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Source samples next to the reference's, with the first reason that excludes a position."""
    ref = reference.select("stack_id", "plane", "y", "x", F.col("value").alias("reference"), F.coalesce("flags", F.lit(0)).alias("reference_flags"))
    joined = source.join(ref, ["stack_id", "plane", "y", "x"])
    if protected is not None:
        mask = protected.select(*KEYS, "y", "x", F.lit(True).alias("_protected")).distinct()
        joined = joined.join(mask, [*KEYS, "y", "x"], "left")
    else:
        joined = joined.withColumn("_protected", F.lit(False))
    reason = (
        F.when(F.coalesce("_protected", F.lit(False)), "protected").when(~clear(F.col("flags")), "source_masked").when(~clear(F.col("reference_flags")), "reference_masked")
        .when(~(finite(F.col("value")) & finite(F.col("reference"))), "non_finite")
    )
    return joined.withColumn("excluded", reason).drop("_protected")


def _cell(p: Grid) -> dict[str, Column]:
    return {"row": F.floor(F.col("y") / p.cell_height).cast("int"), "column": F.floor(F.col("x") / p.cell_width).cast("int")}


def cell_evidence(pairs: DataFrame, parameters: Grid | None = None) -> DataFrame:
    """Counts of eligible and excluded positions of each cell."""
    p = parameters or Grid()
    kinds = ("protected", "source_masked", "reference_masked", "non_finite")
    return pairs.withColumns(_cell(p)).groupBy(*KEYS, "row", "column").agg(
        count_of(F.col("excluded").isNull()).alias("eligible"), *[count_of(F.coalesce(F.col("excluded") == k, F.lit(False))).alias(k) for k in kinds]
    )


def sample_grid(pairs: DataFrame, parameters: Grid | None = None) -> DataFrame:
    """At most ``maximum_samples`` eligible positions of each cell: those with the smallest hash of their position."""
    p = parameters or Grid()
    good = pairs.filter("excluded IS NULL").withColumns(_cell(p)).withColumn("priority", coordinate_priority("y", "x"))
    order = W.partitionBy(*KEYS, "row", "column").orderBy("priority", "y", "x")
    return good.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= p.maximum_samples).select(*KEYS, "row", "column", "y", "x", F.col("value").alias("source"), "reference")


def theil_sen(samples: DataFrame, minimum_samples: int = 3, minimum_scale: float = 1e-6, keys: tuple[str, ...] = (*KEYS, "row", "column")) -> DataFrame:
    """Median of pairwise slopes, median intercept and median absolute residual of each cell, or the reason of failure.

    Pairs stay inside a cell, whose samples are bounded, and medians are exact aggregations.
    """
    keys = list(keys)
    a = samples.select(*keys, F.col("source").alias("s1"), F.col("reference").alias("r1"), F.col("y").alias("y1"), F.col("x").alias("x1"))
    b = samples.select(*keys, F.col("source").alias("s2"), F.col("reference").alias("r2"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    slopes = a.join(b, keys).filter("(y1 < y2 OR (y1 = y2 AND x1 < x2)) AND s1 <> s2")
    slopes = slopes.groupBy(*keys).agg(F.median((F.col("r2") - F.col("r1")) / (F.col("s2") - F.col("s1"))).alias("scale"), F.count(F.lit(1)).alias("slopes"))
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    offset = samples.join(slopes.select(*keys, "scale"), keys).groupBy(*keys).agg(F.median(F.col("reference") - F.col("scale") * F.col("source")).alias("offset"))
    fit = counts.join(slopes, keys, "left").join(offset, keys, "left")
    rest = samples.join(fit.select(*keys, "scale", "offset"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("reference") - (F.col("scale") * F.col("source") + F.col("offset")))).alias("residual"))
    fit = fit.join(rest, keys, "left")
    failure = F.when(F.col("samples") < minimum_samples, "too_few_samples").when(F.col("scale").isNull(), "degenerate_source").when(F.abs("scale") < minimum_scale, "scale_below_minimum")
    fit = fit.withColumn("failure", failure)
    return fit.select(*keys, "samples", "slopes", *[F.when(F.col("failure").isNull(), F.col(c)).alias(c) for c in ("scale", "offset", "residual")], "failure")


@dataclass(frozen=True)
class Surface:
    maximum_neighbours: int = 4
    minimum_neighbours: int = 1
    maximum_distance: float = 512.0

    def __post_init__(self) -> None:
        require(1 <= self.minimum_neighbours <= self.maximum_neighbours <= 64 and self.maximum_distance > 0, "neighbour limits are out of range")


def control_points(fits: DataFrame, parameters: Grid, width: int, height: int) -> DataFrame:
    """Successful cells at their centres; cells at the edges are clipped."""
    left, top = F.col("column") * parameters.cell_width, F.col("row") * parameters.cell_height
    right, bottom = F.least(left + parameters.cell_width, F.lit(width)), F.least(top + parameters.cell_height, F.lit(height))
    return fits.filter("failure IS NULL").select(*KEYS, "row", "column", ((left + right - 1) / 2).alias("cx"), ((top + bottom - 1) / 2).alias("cy"), "scale", "offset")


def evaluate_surface(positions: DataFrame, controls: DataFrame, parameters: Surface, grid: Grid) -> DataFrame:
    """Coefficients at each position by inverse squared distance over its nearest control points.

    Positions meet only controls of cells within reach: an equi-join on cells, not a product with all controls.  A
    position on a control takes it as it is.
    """
    p = parameters
    reach_x = int(np.ceil(p.maximum_distance / grid.cell_width)) + 1
    reach_y = int(np.ceil(p.maximum_distance / grid.cell_height)) + 1
    sent = controls.withColumn("row", F.explode(F.sequence(F.col("row") - reach_y, F.col("row") + reach_y))).withColumn("column", F.explode(F.sequence(F.col("column") - reach_x, F.col("column") + reach_x)))
    at = positions.withColumns(_cell(grid)).join(sent, [*KEYS, "row", "column"])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    at = at.withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= p.maximum_distance**2)
    order = W.partitionBy(*KEYS, "y", "x").orderBy("d2", "cy", "cx")
    at = at.withColumn("n", F.row_number().over(order)).filter((F.col("n") <= p.maximum_neighbours))
    at = at.withColumn("nearest", F.min("d2").over(W.partitionBy(*KEYS, "y", "x")))
    weight = F.when(F.col("nearest") == 0, (F.col("d2") == 0).cast("double")).otherwise(F.try_divide(F.col("nearest"), F.col("d2")))
    found = at.withColumn("w", weight).groupBy(*KEYS, "y", "x").agg(
        (F.sum(F.col("w") * F.col("scale")) / F.sum("w")).alias("scale"), (F.sum(F.col("w") * F.col("offset")) / F.sum("w")).alias("offset"),
        F.count(F.lit(1)).alias("neighbours"), F.min("d2").alias("nearest"),
    )
    return found.filter((F.col("neighbours") >= p.minimum_neighbours) | (F.col("nearest") == 0)).drop("nearest")


def apply_surface(source: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``scale * value + offset``; a position without coefficients keeps its value and becomes MISSING."""
    joined = source.join(coefficients.select(*KEYS, "y", "x", "scale", "offset"), [*KEYS, "y", "x"], "left")
    value = F.col("scale") * F.col("value") + F.col("offset")
    seen = F.coalesce("flags", F.lit(0)).cast("int")
    supported = F.col("scale").isNotNull()
    fine = supported & finite(F.col("value")) & finite(value)
    flags = F.when(~supported, seen.bitwiseOR(F.lit(MISSING))).when(finite(F.col("value")) & ~finite(value), seen.bitwiseOR(F.lit(INVALID))).otherwise(seen)
    return joined.select(*KEYS, "y", "x", F.when(fine, value + 0.0).otherwise(F.col("value")).alias("value"), flags.cast("short").alias("flags"))


@dataclass(frozen=True)
class Protection:
    growth: float = 2.0
    minimum_radius: float = 2.0
    maximum_radius: float = 64.0
    saturated_growth: float = 2.0

    def __post_init__(self) -> None:
        require(0 < self.minimum_radius <= self.maximum_radius and self.growth > 0 and self.saturated_growth >= 1, "protection radii are out of range")


def protection_mask(stars: DataFrame, width: int, height: int, parameters: Protection | None = None) -> DataFrame:
    """Disks around stars: ``(keys, y, x, flags, overlaps)``.  Each star is scattered over its own bounded box."""
    p = parameters or Protection()
    radius = F.col("fwhm_major") * p.growth * F.when(F.col("saturated"), p.saturated_growth).otherwise(1.0)
    disks = stars.select(*KEYS, F.col("x").alias("cx"), F.col("y").alias("cy"), F.least(F.greatest(radius, F.lit(p.minimum_radius)), F.lit(p.maximum_radius)).alias("r"))
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col(c) - F.col("r"))).cast("int"), F.least(F.lit(n - 1), F.floor(F.col(c) + F.col("r"))).cast("int")))
    near = disks.filter(F.col("cx").between(-p.maximum_radius, width) & F.col("cy").between(-p.maximum_radius, height) & (F.col("cx") + F.col("r") >= 0) & (F.col("cy") + F.col("r") >= 0) & (F.col("cx") - F.col("r") <= width - 1) & (F.col("cy") - F.col("r") <= height - 1))
    at = near.withColumn("y", span("cy", height)).withColumn("x", span("cx", width))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    inside = at.filter(dx * dx + dy * dy <= F.col("r") * F.col("r"))
    return inside.groupBy(*KEYS, "y", "x").agg(F.lit(REJECTED).cast("short").alias("flags"), F.count(F.lit(1)).alias("overlaps"))


def normalize(source: DataFrame, reference: DataFrame, width: int, height: int, grid: Grid | None = None, surface: Surface | None = None, protected: DataFrame | None = None) -> DataFrame:
    """The whole operation for all frames at once."""
    grid, surface = grid or Grid(), surface or Surface()
    fits = theil_sen(sample_grid(pair_frames(source, reference, protected), grid))
    controls = control_points(fits, grid, width, height)
    return apply_surface(source, evaluate_surface(source.select(*KEYS, "y", "x"), controls, surface, grid))
