"""Defect detection and correction over 2-D neighbourhoods, defect maps, and large-scale rejection.

A neighbourhood is a scatter: every usable sample is sent to the positions that it is a neighbour of, and one
aggregation per position forms the statistics.  That shuffles (2r+1)^2 - 1 rows per sample for any image size, needs no
halo and no image in memory; ``radius`` is bounded, so the blow-up is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwise.functions.numerics import array_median, median_and_mad
from stackwise.schema import COLD, HOT, IMAGE, MISSING, count_of, eligible, require

from .quality import MAD_SCALE

SPOT = (*IMAGE, "y", "x")


@dataclass(frozen=True)
class LocalDefects:
    radius: int = 2
    stride: int = 1
    minimum_neighbours: int = 6
    hot_sigma: float = 8.0
    cold_sigma: float = 8.0
    minimum_absolute_deviation: float = 0.0

    def __post_init__(self) -> None:
        require(1 <= self.radius <= 8 and self.stride in (1, 2), "radius must be 1 to 8 and stride 1 or 2")
        require(3 <= self.minimum_neighbours <= (2 * self.radius + 1) ** 2 - 1, "minimum_neighbours does not fit the radius")
        require(self.hot_sigma > 0 and self.cold_sigma > 0 and self.minimum_absolute_deviation >= 0, "limits must be positive")


@dataclass(frozen=True)
class LineDefects:
    axis: str = "rows"
    radius: int = 3
    stride: int = 1
    minimum_neighbours: int = 3
    hot_sigma: float = 5.0
    cold_sigma: float = 5.0
    minimum_absolute_deviation: float = 0.0
    minimum_affected: int = 3
    minimum_affected_ppm: int = 500_000

    def __post_init__(self) -> None:
        require(self.axis in ("rows", "columns"), "axis must be rows or columns")
        require(1 <= self.radius <= 64 and self.stride in (1, 2), "radius must be 1 to 64 and stride 1 or 2")
        require(self.minimum_affected >= 1 and 0 < self.minimum_affected_ppm <= 1_000_000, "the line gate is out of range")


def around(samples: DataFrame, offsets: list[tuple[int, int]], value: str = "value") -> DataFrame:
    """``values``: for each position the sorted values of its neighbours at ``offsets`` (dy, dx)."""
    at = F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x")) for dy, dx in offsets])
    sent = samples.select(*IMAGE, F.explode(at).alias("at"), F.col(value).alias("v"))
    return sent.groupBy(*IMAGE, F.col("at.y").alias("y"), F.col("at.x").alias("x")).agg(F.sort_array(F.collect_list("v")).alias("values"))


def square(radius: int, stride: int) -> list[tuple[int, int]]:
    steps = range(-radius * stride, radius * stride + 1, stride)
    return [(dy, dx) for dy in steps for dx in steps if (dy, dx) != (0, 0)]


def _decide(found: DataFrame, least: int, hot: float, cold: float, floor: float) -> DataFrame:
    """Adds ``decision`` from the sorted neighbour ``values``."""
    found = found.withColumn("_near", median_and_mad(F.col("values")))
    found = found.withColumns({"_apart": F.col("value") - F.col("_near.median"), "_sigma": F.col("_near.mad") * MAD_SCALE})
    apart = F.col("_apart")
    usable = eligible()
    decision = (
        F.when(~usable, "unavailable")
        .when(F.coalesce(F.size("values"), F.lit(0)) < least, "insufficient_support")
        .when(F.abs(apart) <= floor, "clear")
        .when(apart > F.col("_sigma") * hot, "hot")
        .when(apart < -(F.col("_sigma") * cold), "cold")
        .otherwise("clear")
    )
    return found.withColumn("decision", decision).drop("_near", "_apart", "_sigma", "values")


def local_decisions(samples: DataFrame, p: LocalDefects) -> DataFrame:
    near = around(samples.filter(eligible()), square(p.radius, p.stride))
    joined = samples.join(near, list(SPOT), "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))
    return _decide(joined, p.minimum_neighbours, p.hot_sigma, p.cold_sigma, p.minimum_absolute_deviation)


def _flag() -> Column:
    return F.when(F.col("decision") == "hot", HOT).when(F.col("decision") == "cold", COLD)


def detect_local_defects(samples: DataFrame, parameters: LocalDefects | None = None) -> DataFrame:
    """The defect map: ``(stack_id, frame_id, plane, y, x, defect)`` of positions far from their neighbours' median."""
    found = local_decisions(samples, parameters or LocalDefects()).withColumn("defect", _flag().cast("short"))
    return found.filter("defect IS NOT NULL").select(*SPOT, "defect")


def detection_evidence(samples: DataFrame, parameters: LocalDefects | None = None) -> DataFrame:
    """Counts of every kind of decision for each image."""
    found = local_decisions(samples, parameters or LocalDefects())
    kinds = ("unavailable", "insufficient_support", "hot", "cold")
    return found.groupBy(*IMAGE).agg(F.count(F.lit(1)).alias("examined"), *[count_of(F.col("decision") == k).alias(k) for k in kinds])


def merge_defect_maps(*maps: DataFrame) -> DataFrame:
    """Union of the flags at (plane, y, x) over all maps and frames; ``conflict`` where hot meets cold."""
    every = maps[0]
    for m in maps[1:]:
        every = every.unionByName(m)
    merged = every.groupBy("plane", "y", "x").agg(F.bit_or(F.col("defect").cast("int")).alias("defect"), F.count(F.lit(1)).alias("votes"))
    return merged.withColumn("conflict", F.col("defect").bitwiseAND(F.lit(HOT | COLD)) == (HOT | COLD))


def merge_evidence(merged: DataFrame) -> DataFrame:
    bit = lambda b: F.col("defect").bitwiseAND(F.lit(b)) != 0
    return merged.agg(F.count(F.lit(1)).alias("mapped"), count_of(bit(HOT)).alias("hot"), count_of(bit(COLD)).alias("cold"), count_of(F.col("conflict")).alias("conflicts"))


def correct_defects(samples: DataFrame, defects: DataFrame, offsets: list[tuple[int, int]] | None = None, minimum_neighbours: int = 3) -> DataFrame:
    """Mapped samples replaced by the median of clean, unmapped neighbours of the input.

    A mapped sample with a flag that isn't a defect's stays as it is; one with thin support becomes NaN and MISSING.
    ``defects``: (plane, y, x, defect), applied to every frame; its size is that of one sensor.
    """
    offsets = offsets or square(2, 1)
    mapped = defects.select("plane", "y", "x", F.lit(True).alias("_mapped")).distinct()
    joined = samples.join(mapped, ["plane", "y", "x"], "left").withColumn("_mapped", F.coalesce("_mapped", F.lit(False)))
    near = around(joined.filter(eligible() & ~F.col("_mapped")), offsets)
    joined = joined.join(near, list(SPOT), "left")
    foreign = F.coalesce("flags", F.lit(0)).cast("int").bitwiseAND(F.lit(~(HOT | COLD) & 0xFF)) != 0
    enough = F.coalesce(F.size("values"), F.lit(0)) >= minimum_neighbours
    outcome = F.when(~F.col("_mapped"), "kept").when(foreign, "blocked").when(enough, "corrected").otherwise("unsupported")
    joined = joined.withColumn("outcome", outcome)
    value = F.when(F.col("outcome") == "corrected", array_median(F.col("values"))).when(F.col("outcome") == "unsupported", float("nan")).otherwise(F.col("value"))
    flags = F.when(F.col("outcome") == "corrected", 0).when(F.col("outcome") == "unsupported", F.coalesce("flags", F.lit(0)).cast("int").bitwiseOR(F.lit(MISSING))).otherwise(F.col("flags"))
    return joined.withColumns({"value": value, "flags": flags.cast("short")}).select(*samples.columns, "outcome")


def line_offsets(p: LineDefects) -> list[tuple[int, int]]:
    steps = [k * p.stride for k in range(-p.radius, p.radius + 1) if k]
    return [(k, 0) for k in steps] if p.axis == "rows" else [(0, k) for k in steps]


def line_decisions(samples: DataFrame, p: LineDefects) -> DataFrame:
    near = around(samples.filter(eligible()), line_offsets(p))
    joined = samples.join(near, list(SPOT), "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))
    return _decide(joined, p.minimum_neighbours, p.hot_sigma, p.cold_sigma, p.minimum_absolute_deviation)


def line_gates(decided: DataFrame, p: LineDefects) -> DataFrame:
    """Per line whether enough of its supported samples are hot, or cold; an exact comparison of integers."""
    line = "y" if p.axis == "rows" else "x"
    kinds = {k: count_of(F.col("decision") == k).alias(k) for k in ("hot", "cold")}
    lines = decided.groupBy(*IMAGE, F.col(line).alias("line")).agg(count_of(F.col("decision").isin("clear", "hot", "cold")).alias("supported"), *kinds.values())

    def gate(k: str) -> Column:
        return (F.col(k) >= p.minimum_affected) & (F.col("supported") > 0) & (F.col(k) * 1_000_000 >= F.col("supported") * p.minimum_affected_ppm)

    return lines.select("*", gate("hot").alias("hot_line"), gate("cold").alias("cold_line"))


def detect_linear_defects(samples: DataFrame, parameters: LineDefects | None = None) -> DataFrame:
    """The defect map of whole rows or columns that differ from the lines beside them."""
    p = parameters or LineDefects()
    decided = line_decisions(samples, p)
    gates = line_gates(decided, p).filter("hot_line OR cold_line").select(*IMAGE, "line", "hot_line", "cold_line")
    joined = decided.withColumn("line", F.col("y" if p.axis == "rows" else "x")).join(gates, [*IMAGE, "line"])
    mapped = ((F.col("decision") == "hot") & F.col("hot_line")) | ((F.col("decision") == "cold") & F.col("cold_line"))
    return joined.filter(mapped).select(*SPOT, _flag().cast("short").alias("defect"))


def correct_linear_defects(samples: DataFrame, defects: DataFrame, parameters: LineDefects | None = None, minimum_neighbours: int = 2) -> DataFrame:
    """Mapped samples replaced by the median of clean samples of the lines beside theirs."""
    return correct_defects(samples, defects, line_offsets(parameters or LineDefects()), minimum_neighbours)


@dataclass(frozen=True)
class LargeScale:
    """``layers`` and ``growth`` of one tail."""

    layers: int = 2
    growth: int = 1

    def __post_init__(self) -> None:
        require(1 <= self.layers <= 12 and 0 <= self.growth <= 256, "layers must be 1 to 12 and growth 0 to 256")

    @property
    def radius(self) -> int:
        return 1 << (self.layers - 1)


def box_sums(points: DataFrame, radius: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """``(keys, y, x, near)`` at each point: how many points lie in the square around it, itself included.

    Two range windows over sparse points: rows first, then columns, after the counts of a row were sent to the rows
    that they reach.
    """
    row = W.partitionBy(*keys, "row").orderBy("x").rangeBetween(-radius, radius)
    reach = F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius))
    rows = points.select(*keys, "x", F.col("y"), reach.alias("row")).withColumn("own", F.col("row") == F.col("y"))
    counted = rows.withColumn("near", F.count(F.lit(1)).over(row))
    return counted.filter("own").select(*keys, "y", "x", "near")


def large_scale_seeds(found: DataFrame, tail: str, parameters: LargeScale) -> DataFrame:
    """Rejected samples whose neighbourhood holds at least one detection diameter of rejects of the same tail."""
    rejects = found.filter(F.col("disposition") == f"rejected_{tail}").select(*SPOT)
    return box_sums(rejects, parameters.radius).filter(F.col("near") >= 2 * parameters.radius + 1).select(*SPOT)


def grow_seeds(seeds: DataFrame, growth: int) -> DataFrame:
    """All positions within ``growth`` of a seed, by rows and columns in turn; edges are clipped by later joins."""
    wide = seeds.select(*IMAGE, "y", F.explode(F.sequence(F.col("x") - growth, F.col("x") + growth)).alias("x")).distinct()
    return wide.select(*IMAGE, F.explode(F.sequence(F.col("y") - growth, F.col("y") + growth)).alias("y"), "x").distinct()


def expand_large_scale(found: DataFrame, low: LargeScale | None, high: LargeScale | None, minimum_retained: int = 3) -> DataFrame:
    """Dispositions after promotion: accepted samples that exactly one grown tail reaches become rejected.

    Samples that both tails reach stay accepted.  A position where fewer than ``minimum_retained`` samples would remain
    is left as it was.
    """
    joined = found
    for name, p in (("low", low), ("high", high)):
        if p is None:
            joined = joined.withColumn(f"_{name}", F.lit(False))
        else:
            grown = grow_seeds(large_scale_seeds(found, name, p), p.growth).withColumn(f"_{name}", F.lit(True))
            joined = joined.join(grown, list(SPOT), "left").withColumn(f"_{name}", F.coalesce(f"_{name}", F.lit(False)))
    accepted = F.col("disposition") == "accepted"
    proposed = accepted & (F.col("_low") != F.col("_high"))
    here = W.partitionBy("stack_id", "plane", "y", "x")
    joined = joined.withColumn("_left", F.sum((accepted & ~proposed).cast("long")).over(here))
    go = proposed & (F.col("_left") >= minimum_retained)
    now = F.when(go & F.col("_low"), "rejected_low").when(go, "rejected_high").otherwise(F.col("disposition"))
    return joined.withColumn("disposition", now).select(*found.columns)


