"""Executors: whole calibration, registration, stacking and drizzle jobs, composed of the operators.

A job is one lazy plan; parallelism, spilling and retries are Spark's.  Jobs can be cancelled by their group.  The
estimates say how many bytes a job's positions hold at once, so that partitions can be sized before it runs.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.functions.geometry import Projective
from stackwise.operators import calibrate, defects, drizzle, integrate, localnorm, quality, registration, resample
from stackwise.schema import PIXEL, finite, require

# Bytes of one sample in memory: value, flags, position and row overhead.
SAMPLE_BYTES = 48


def stack_calibrated(lights: DataFrame, dark: DataFrame, flat: DataFrame, minimum_flat: float, estimator: str = "strict_mean", **parameters) -> DataFrame:
    """Calibrate every light and integrate them."""
    return integrate.integrate(calibrate.calibrate_dark_flat(lights, dark, flat, minimum_flat), estimator, **parameters)


def build_master(frames: DataFrame, kind: str, pedestal: DataFrame | None = None) -> DataFrame:
    """A bias or dark master; a flat is freed of its pedestal, integrated and normalised."""
    if kind != "flat":
        return calibrate.master(frames, kind)
    frames = calibrate.subtract_pedestal(frames, pedestal) if pedestal is not None else frames
    mean = calibrate.master(frames, kind).withColumn("frame_id", F.lit(0).cast("long"))
    return calibrate.normalize_flat(mean, keys=("stack_id",))


def execute_light_plan(samples: DataFrame, frames: DataFrame, plan: DataFrame, masters: DataFrame, minimum_flat: float) -> DataFrame:
    """Every light of every ready group calibrated with its own masters, in one join over all groups.

    ``frames``: (frame_id, group_id); ``plan``: light_id, dark_id, flat_id; ``masters``: (group_id, plane, y, x, value,
    flags).  Groups that are not ready are left out.
    """
    ready = plan.filter("ready").select(F.col("light_id").alias("group_id"), "dark_id", "flat_id")
    tagged = samples.join(frames.select("frame_id", "group_id"), "frame_id").join(ready, "group_id")
    side = lambda key, name: masters.select(F.col("group_id").alias(key), "plane", "y", "x", F.col("value").alias(f"{name}_value"), F.coalesce("flags", F.lit(0)).cast("int").alias(f"{name}_flags"))
    spot = ["plane", "y", "x"]
    joined = tagged.join(side("dark_id", "dark"), ["dark_id", *spot], "left").join(side("flat_id", "flat"), ["flat_id", *spot], "left")
    seen = F.coalesce("flags", F.lit(0)).cast("int").bitwiseOR(F.coalesce("dark_flags", F.lit(0))).bitwiseOR(F.coalesce("flat_flags", F.lit(0)))
    good = finite(F.col("value")) & finite(F.col("dark_value")) & finite(F.col("flat_value")) & (F.abs("flat_value") > minimum_flat)
    result = F.try_divide(F.col("value") - F.col("dark_value"), F.col("flat_value"))
    return calibrate._outcome(joined, seen, good, result, [*samples.columns, "group_id"])


def correct_defects(lights: DataFrame, references: list[DataFrame], parameters: defects.LocalDefects | None = None) -> DataFrame:
    """Defect maps of all references merged and applied to the lights."""
    merged = defects.merge_defect_maps(*[defects.detect_local_defects(r, parameters) for r in references])
    return defects.correct_defects(lights, merged)


def correct_lines(lights: DataFrame, reference: DataFrame, parameters: defects.LineDefects | None = None) -> DataFrame:
    return defects.correct_linear_defects(lights, defects.detect_linear_defects(reference, parameters), parameters)


def execute_registration(samples: DataFrame, plan: dict, source_width: int, source_height: int) -> DataFrame:
    """All frames of a sealed plan on the reference grid, in one scan and one shuffle."""
    shapes = {f["frame_id"]: Projective.of([f["matrix"][k : k + 3] for k in (0, 3, 6)]) for f in plan["frames"]}
    return resample.resample(samples, source_width, source_height, plan["width"], plan["height"], shapes)


def registered_stack(registered: DataFrame, estimator: str, crop: tuple[int, int, int, int] | None = None, **parameters) -> dict[str, DataFrame]:
    """Science image with its support and rejection companions; the crop reaches the scan as a filter."""
    if crop is not None:
        registered = integrate.crop(registered, *crop)
    science = integrate.integrate(registered, estimator, **parameters)
    return {"science": science, "support": integrate.support_map(science), "rejection": integrate.rejection_maps(science)}


def stack_with_large_scale(registered: DataFrame, esd: integrate.GeneralizedEsd, low: defects.LargeScale | None, high: defects.LargeScale | None) -> DataFrame:
    """ESD dispositions, promotion around large-scale seeds, and the image rebuilt from what remains."""
    found = integrate.dispositions(registered, esd)
    return integrate.rebuild(defects.expand_large_scale(found, low, high, esd.minimum_retained))


def local_normalization(source: DataFrame, reference: DataFrame, width: int, height: int, stars: DataFrame | None = None, grid: localnorm.Grid | None = None, surface: localnorm.Surface | None = None) -> DataFrame:
    protected = localnorm.protection_mask(stars, width, height) if stars is not None else None
    return localnorm.normalize(source, reference, width, height, grid, surface, protected)


def drizzle_output(samples: DataFrame, transforms: dict[int, Projective] | DataFrame, parameters: drizzle.Drizzle, pattern: str | None = None, weights: dict[int, float] | DataFrame | None = None) -> DataFrame:
    return drizzle.finish(drizzle.accumulate(drizzle.scatter(samples, transforms, parameters, pattern, weights)), parameters)


def diagnose(source: DataFrame, reference: DataFrame, width: int, height: int, stars: quality.StarMeasurement | None = None, features: registration.FeatureSelection | None = None,
             triangles: registration.Triangles | None = None, matching: registration.Matching | None = None, consensus: registration.Consensus | None = None, confidence: registration.Confidence | None = None) -> DataFrame:
    """Stars, features, triangles, matches, consensus and confidence for frame pairs: source frames against one reference."""
    catalog = lambda s: registration.feature_catalog(quality.measure_stars(s, stars), width, height, features).filter("rank IS NOT NULL").select("frame_id", F.col("rank").cast("long").alias("rank"), "x", "y")
    a, b = catalog(source), catalog(reference)
    found = registration.match_triangles(registration.triangle_descriptors(a, triangles), registration.triangle_descriptors(b, triangles), matching)
    return registration.confidence(registration.similarity_consensus(found, a, b, consensus), width, height, confidence)


@contextmanager
def cancellable(spark: SparkSession, group: str, description: str = ""):
    """Jobs inside can be stopped from any thread with ``cancel``."""
    spark.sparkContext.setJobGroup(group, description, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def progress(spark: SparkSession, group: str) -> dict[str, int]:
    """Finished and all tasks of a group's stages."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) if (i := tracker.getJobInfo(j)) for k in i.stageIds if (s := tracker.getStageInfo(k))]
    return {"completed": sum(s.numCompletedTasks for s in stages), "total": sum(s.numTasks for s in stages)}


def estimate_bytes(width: int, height: int, planes: int = 1, frames: int = 1, neighbours: int = 0) -> dict[str, int]:
    """Bytes of a job's samples, of what a neighbourhood scatter makes of them, and partitions of 128 MB."""
    require(min(width, height, planes, frames) > 0 and neighbours >= 0, "sizes must be positive")
    samples = width * height * planes * frames
    scatter = samples * neighbours * SAMPLE_BYTES
    total = samples * SAMPLE_BYTES + scatter
    return {"samples": samples, "sample_bytes": samples * SAMPLE_BYTES, "scatter_bytes": scatter, "partitions": max(1, -(-total // (128 << 20)))}


def estimate_defects(width: int, height: int, planes: int = 1, p: defects.LocalDefects | None = None) -> dict[str, int]:
    return estimate_bytes(width, height, planes, 1, (2 * (p or defects.LocalDefects()).radius + 1) ** 2 - 1)


def estimate_lines(width: int, height: int, planes: int = 1, p: defects.LineDefects | None = None) -> dict[str, int]:
    return estimate_bytes(width, height, planes, 1, 2 * (p or defects.LineDefects()).radius)


def estimate_local_normalization(width: int, height: int, planes: int = 1, grid: localnorm.Grid | None = None) -> dict[str, int]:
    """Cells, samples that they keep, and pairs of the slope estimate."""
    g = grid or localnorm.Grid()
    cells = -(-width // g.cell_width) * -(-height // g.cell_height) * planes
    n = min(g.maximum_samples, g.cell_width * g.cell_height)
    return {"cells": cells, "samples": cells * n, "pairs": cells * n * (n - 1) // 2} | estimate_bytes(width, height, planes)


def estimate_drizzle(width: int, height: int, frames: int, p: drizzle.Drizzle) -> dict[str, int]:
    """Contributions: a footprint touches about ``(drop * scale + 1)^2`` positions."""
    touched = int((p.drop * p.scale + 1) ** 2) + 1
    return estimate_bytes(width, height, 1, frames, touched)


def band_plan(height: int, bytes_per_row: int, limit: int) -> list[tuple[int, int]]:
    """The tallest equal bands of rows that keep within a limit of bytes: (first row, rows)."""
    require(bytes_per_row <= limit, "one row does not fit the limit")
    rows = max(1, min(height, limit // bytes_per_row))
    return [(y, min(rows, height - y)) for y in range(0, height, rows)]


def verify_same(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = PIXEL) -> bool:
    """Whether two results agree row by row, in either direction."""
    return before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()




class MemoryBudget:
    """Admission of driver-side work: reservations of bytes that together never exceed the limit, from any thread."""

    def __init__(self, limit: int):
        require(limit > 0, "a budget needs a positive limit")
        self.limit, self.used, self.peak = limit, 0, 0
        self._lock = threading.Lock()

    @property
    def available(self) -> int:
        return self.limit - self.used

    @contextmanager
    def try_reserve(self, size: int):
        """Hold ``size`` bytes inside the block; an error at once if they are not there."""
        require(size > 0, "a reservation needs a positive size")
        with self._lock:
            require(size <= self.limit - self.used, f"{size} bytes do not fit: {self.limit - self.used} of {self.limit} are free")
            self.used += size
            self.peak = max(self.peak, self.used)
        try:
            yield size
        finally:
            with self._lock:
                self.used -= size
