"""Drizzle: every detector sample is scattered over the output positions that its shrunken footprint touches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.functions.geometry import Projective
from stackwise.schema import MISSING, eligible, require

from .resample import output_grid, sampled_channel


@dataclass(frozen=True)
class Drizzle:
    scale: float = 1.0
    drop: float = 1.0
    width: int = 0
    height: int = 0
    maximum_contributions: int = 4096

    def __post_init__(self) -> None:
        require(self.scale > 0 and 0 < self.drop <= 1, "scale must be positive and drop in (0, 1]")
        require(self.width > 0 and self.height > 0, "the output needs a positive size")


def corners(x: np.ndarray, y: np.ndarray, matrix: np.ndarray, p: Drizzle) -> np.ndarray:
    """Corners ``(n, 4, 2)`` of the footprints in output coordinates; ``matrix``: the nine entries of each sample's transform."""
    h = p.drop / 2
    cx = x[:, None] + np.array([-h, h, h, -h])
    cy = y[:, None] + np.array([-h, -h, h, h])
    a, b, c, d, e, f, g, i, k = (column[:, None] for column in matrix.T)
    w = g * cx + i * cy + k
    if (np.sign(w).min(axis=1) != np.sign(w).max(axis=1)).any() or (w == 0).any():
        raise ValueError("a footprint crosses the horizon of its transform")
    u, v = (a * cx + b * cy + c) / w, (d * cx + e * cy + f) / w
    return np.stack([(u + 0.5) * p.scale - 0.5, (v + 0.5) * p.scale - 0.5], axis=2)


def areas(polygons: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Areas of ``(n, K, 2)`` polygons of which the first ``count`` vertices are used."""
    total = np.zeros(len(polygons))
    row = np.arange(len(polygons))
    for k in range(polygons.shape[1]):
        live = k < count
        j = np.where(k + 1 < count, k + 1, 0)
        p, q = polygons[:, k], polygons[row, j]
        total += np.where(live, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], 0.0)
    return np.abs(total) / 2


def clip(polygons: np.ndarray, count: np.ndarray, axis: int, bound: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """The parts of convex polygons on one side of axis-parallel lines; each gains one vertex at most."""
    n, size, _ = polygons.shape
    out, held, row = np.zeros((n, size + 1, 2)), np.zeros(n, np.int64), np.arange(n)
    distance = (polygons[:, :, axis] - bound[:, None]) * (1 if above else -1)

    def put(where: np.ndarray, points: np.ndarray) -> None:
        out[row[where], held[where]] = points
        held[where] += 1

    for k in range(size):
        live = k < count
        j = np.where(k + 1 < count, k + 1, 0)
        here, there = distance[:, k], distance[row, j]
        inside = live & (here >= 0)
        put(inside, polygons[inside, k])
        cross = live & ((here > 0) != (there > 0)) & (here != there)
        t = np.where(cross, here / np.where(cross, here - there, 1.0), 0.0)
        cross &= (t > 0) & (t < 1)
        put(cross, polygons[cross, k] + t[cross, None] * (polygons[row[cross], j[cross]] - polygons[cross, k]))
    return out, held


def deposits(polygons: np.ndarray, p: Drizzle) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(index, y, x, part)``: how each footprint's area is divided over the output; parts off the output are lost."""
    four = np.full(len(polygons), 4)
    whole = areas(polygons, four)
    low = np.floor(polygons.min(axis=1) + 0.5).astype(np.int64)
    high = (np.ceil(polygons.max(axis=1) + 0.5) - 1).astype(np.int64)
    if ((high - low + 1).prod(axis=1) > p.maximum_contributions).any():
        raise ValueError(f"a footprint touches more than {p.maximum_contributions} positions")
    low = np.maximum(low, 0)
    high = np.minimum(high, [p.width - 1, p.height - 1])
    size = np.maximum(high - low + 1, 0)
    cells = np.where(whole > 0, size.prod(axis=1), 0)
    index = np.repeat(np.arange(len(polygons)), cells)
    k = np.arange(len(index)) - np.repeat(np.cumsum(cells) - cells, cells)
    y, x = low[index, 1] + k // np.maximum(size[index, 0], 1), low[index, 0] + k % np.maximum(size[index, 0], 1)
    part, count = polygons[index], np.full(len(index), 4)
    for axis, at in ((1, y), (0, x)):
        for side, above in ((-0.5, True), (0.5, False)):
            part, count = clip(part, count, axis, at + side, above)
    share = np.where(count >= 3, areas(part, count), 0.0) / whole[index]
    got = share > 0
    return index[got], y[got], x[got], share[got]


def frame_table(spark: SparkSession, transforms: dict[int, Projective]) -> DataFrame:
    """``(frame_id, matrix)`` with the nine entries of each transform, row by row."""
    return spark.createDataFrame([(int(f), [v for row in t.rows for v in row]) for f, t in transforms.items()], "frame_id long, matrix array<double>")


def scatter(samples: DataFrame, transforms: dict[int, Projective] | DataFrame, parameters: Drizzle, pattern: str | None = None, weights: dict[int, float] | DataFrame | None = None) -> DataFrame:
    """Contributions ``(stack_id, plane, y, x, flux, weight)`` of all usable samples.

    ``transforms`` and ``weights`` have one entry per frame, as a dict or as a table: ``(frame_id, matrix)`` with nine
    entries row by row, and ``(frame_id, weight)``; a frame without a weight has 1.  They are joined, so no worker holds
    those of all frames.  With a mosaic ``pattern`` the plane is the colour of the sample's own position.  Masked and
    non-finite samples are left out before any geometry.
    """
    p, spark = parameters, samples.sparkSession
    plane = sampled_channel(pattern, F.col("y"), F.col("x")) if pattern else F.col("plane")
    shapes = transforms if isinstance(transforms, DataFrame) else frame_table(spark, transforms)
    shapes = shapes.select(F.col("frame_id").alias("_frame"), "matrix", F.lit(1.0).alias("_weight"))
    if weights is not None:
        heavy = weights if isinstance(weights, DataFrame) else spark.createDataFrame([(int(f), float(w)) for f, w in weights.items()], "frame_id long, weight double")
        heavy = heavy.select(F.col("frame_id").alias("_heavy"), F.col("weight").alias("_own"))
        shapes = shapes.join(heavy, F.col("_frame") == F.col("_heavy"), "left").select("_frame", "matrix", F.coalesce("_own", "_weight").alias("_weight"))
    good = samples.filter(eligible()).select("stack_id", "frame_id", plane.cast("int").alias("plane"), "y", "x", "value")
    good = good.join(shapes, F.col("frame_id") == F.col("_frame"), "left")
    missing = F.raise_error(F.concat(F.lit("no transform for frame "), F.coalesce(F.col("frame_id").cast("string"), F.lit("null")))).cast("double")
    entries = [F.get("matrix", F.lit(k)).alias(f"_m{k}") for k in range(9)]
    sent = good.select("stack_id", "plane", "y", "x", "value", F.when(F.coalesce(F.size("matrix"), F.lit(0)) == 9, F.col("_weight")).otherwise(missing).alias("_weight"), *entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                stack, plane, y, x, value, w, *matrix = (c.to_numpy(zero_copy_only=False) for c in batch.slice(first, 8192).columns)
                own, oy, ox, part = deposits(corners(x.astype(float), y.astype(float), np.stack(matrix, axis=1), p), p)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c.astype(np.int32)) for c in (stack[own], plane[own], oy, ox)), pa.array(value[own] * w[own] * part), pa.array(w[own] * part)],
                    ["stack_id", "plane", "y", "x", "flux", "weight"],
                )

    return sent.mapInArrow(run, "stack_id int, plane int, y int, x int, flux double, weight double")


def accumulate(contributions: DataFrame) -> DataFrame:
    """Sums of flux and weight and the number of contributions at each position; partial sums come first."""
    return contributions.groupBy("stack_id", "plane", "y", "x").agg(F.sum("flux").alias("flux"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("contributions"))


def finish(sums: DataFrame, parameters: Drizzle) -> DataFrame:
    """``value = flux / weight`` on the whole output grid; positions without weight are NaN and MISSING."""
    grid = output_grid(sums.sparkSession, parameters.width, parameters.height)
    planes = sums.select("stack_id", "plane").distinct()
    every = grid.crossJoin(planes)  # the whole grid for each plane
    out = every.join(sums, ["stack_id", "plane", "y", "x"], "left")
    got = F.coalesce(F.col("weight") > 0, F.lit(False))
    return out.select(
        "stack_id", "plane", "y", "x", F.when(got, F.col("flux") / F.col("weight")).otherwise(float("nan")).alias("value"), F.when(got, 0).otherwise(MISSING).cast("short").alias("flags"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("contributions", F.lit(0)).cast("long").alias("contributions"),
    )


def source_window(transform: Projective, p: Drizzle, y0: int, rows: int) -> tuple[float, float, float, float]:
    """Conservative ``(top, left, bottom, right)`` of the source that can reach a band of the output."""
    x = (np.array([-0.5, p.width - 0.5] * 2) + 0.5) / p.scale - 0.5
    y = (np.array([y0 - 0.5, y0 - 0.5, y0 + rows - 0.5, y0 + rows - 0.5]) + 0.5) / p.scale - 0.5
    u, v = transform.inverse().apply(x, y)
    return float(np.floor(v.min() - 1)), float(np.floor(u.min() - 1)), float(np.ceil(v.max() + 1)), float(np.ceil(u.max() + 1))
