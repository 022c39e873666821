"""Lanczos-3 resampling through affine or projective transforms, demosaicing and common footprints.

An output is made in bands of rows.  Each band needs the source rows that ``source_window`` names; rows are sent to the
bands that need them, and a band of one plane is one Arrow group, whatever the size of the image.  ``resample_by_taps``
says the same as a join: each output position knows the up to 36 source taps that it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwise.functions.geometry import Affine, Projective
from stackwise.schema import INVALID, MISSING, clear, count_of, finite, or_flags, require

#: A sum of weights below this has no meaningful quotient.
LEAST_WEIGHT = 1e-12


def lanczos3(d: Column) -> Column:
    """sinc(d) sinc(d / 3) within three samples; exactly 0 at whole distances other than 0."""
    x = d * np.pi
    return F.when(d == 0, 1.0).when((F.abs(d) >= 3) | (d == F.round(d)), 0.0).otherwise(3 * F.sin(x) * F.sin(x / 3) / (x * x))


def complete(coordinate: Column, length: int) -> Column:
    """Whether all taps with weight lie inside: a whole coordinate needs itself only."""
    base = F.floor(coordinate)
    return F.when(coordinate == base, coordinate.between(0, length - 1)).otherwise((base - 2 >= 0) & (base + 3 <= length - 1))


def output_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All positions of an output, from a range: nothing is collected."""
    return spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def mapped_grid(spark: SparkSession, width: int, height: int, transform: Affine | Projective) -> DataFrame:
    """Output positions with their source coordinates."""
    u, v = transform.inverse().apply(F.col("x").cast("double"), F.col("y").cast("double"))
    return output_grid(spark, width, height).withColumns({"u": u, "v": v})


def taps(grid: DataFrame, source_width: int, source_height: int) -> DataFrame:
    """Six by six taps of each position whose support is complete: (y, x, sy, sx, weight), zero weights left out."""
    inside = grid.filter(complete(F.col("u"), source_width) & complete(F.col("v"), source_height))
    step = F.sequence(F.lit(-2), F.lit(3))
    out = inside.withColumn("sx", F.explode(F.transform(step, lambda k: (F.floor("u") + k).cast("int"))))
    out = out.withColumn("wx", lanczos3(F.col("u") - F.col("sx"))).filter("wx <> 0")
    out = out.withColumn("sy", F.explode(F.transform(step, lambda k: (F.floor("v") + k).cast("int"))))
    out = out.withColumn("wy", lanczos3(F.col("v") - F.col("sy"))).filter("wy <> 0")
    return out.select("y", "x", "sy", "sx", (F.col("wx") * F.col("wy")).alias("weight"))


def resample_by_taps(source: DataFrame, source_width: int, source_height: int, width: int, height: int, transform: Affine | Projective) -> DataFrame:
    """Frames (stack_id, frame_id, plane) resampled to the reference grid; positions without full clean support are NaN.

    A bad tap passes its flags on with MISSING; a position off the source is MISSING alone.
    """
    require(width > 0 and height > 0, "the output needs a positive size")
    spark = source.sparkSession
    grid = mapped_grid(spark, width, height, transform)
    images = source.select("stack_id", "frame_id", "plane").distinct()
    points = taps(grid, source_width, source_height)
    side = source.select("stack_id", "frame_id", "plane", F.col("y").alias("sy"), F.col("x").alias("sx"), "value", "flags")
    bad = ~(clear(F.col("flags")) & finite(F.col("value")))
    met = points.join(side, ["sy", "sx"]).groupBy("stack_id", "frame_id", "plane", "y", "x").agg(
        F.sum(F.col("weight") * F.when(~bad, F.col("value"))).alias("top"), F.sum("weight").alias("bottom"),
        count_of(bad).alias("bad"), F.count(F.lit(1)).alias("met"), or_flags().alias("seen"), count_of(clear(F.col("flags")) & ~finite(F.col("value"))).alias("nan"),
    )
    needed = points.groupBy("y", "x").agg(F.count(F.lit(1)).alias("needed"))
    every = grid.select("y", "x").crossJoin(images)  # the whole grid for each image
    out = every.join(met, ["stack_id", "frame_id", "plane", "y", "x"], "left").join(needed, ["y", "x"], "left")
    good = (F.col("bad") == 0) & (F.col("met") == F.col("needed")) & (F.abs("bottom") >= LEAST_WEIGHT)
    good = F.coalesce(good, F.lit(False))
    flags = F.coalesce("seen", F.lit(0)).bitwiseOR(F.lit(MISSING)).bitwiseOR(F.when(F.col("nan") > 0, INVALID).otherwise(0))
    return out.select("stack_id", "frame_id", "plane", "y", "x", F.when(good, F.col("top") / F.col("bottom")).otherwise(float("nan")).alias("value"), F.when(good, 0).otherwise(flags).cast("short").alias("flags"))


def source_window(width: int, height: int, transform: Affine | Projective, y0: int, rows: int) -> tuple[int, int, int, int] | None:
    """``(top, left, bottom, right)``, inclusive, of the source that a band of the output can need; None if nothing."""
    inverse = transform.inverse()
    x = np.array([0, width - 1, 0, width - 1], np.float64)
    y = np.array([y0, y0, y0 + rows - 1, y0 + rows - 1], np.float64)
    u, v = inverse.apply(x, y)
    if not (np.isfinite(u).all() and np.isfinite(v).all()):
        return None
    top, left, bottom, right = int(np.floor(v.min())) - 2, int(np.floor(u.min())) - 2, int(np.floor(v.max())) + 3, int(np.floor(u.max())) + 3
    return top, left, bottom, right


IMAGE = ("stack_id", "frame_id", "plane")
#: Bands of all frames up to which a plan is broadcast.
SMALL_PLAN = 100_000
RESAMPLED = "stack_id int, frame_id long, plane int, y int, x int, value double, flags smallint"


def _axis(c: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First taps, six weights and completeness along one axis; whole distances other than 0 weigh exactly 0."""
    base = np.floor(c)
    d = c[:, None] - (base[:, None] + np.arange(-2, 4))
    with np.errstate(invalid="ignore"):
        weight = np.sinc(d) * np.sinc(d / 3)
    weight = np.where(d == 0, 1.0, np.where((np.abs(d) >= 3) | (d == np.round(d)), 0.0, weight))
    whole = c == base
    done = np.where(whole, (c >= 0) & (c <= length - 1), (base - 2 >= 0) & (base + 3 <= length - 1))
    return base - 2, weight, done & np.isfinite(c)


def _band(rows: pa.Table, y0: int, count: int, width: int, transform: Affine | Projective, source_width: int, source_height: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and flags of ``count`` output rows from the source rows that are there."""
    sy = rows["y"].to_numpy()
    real = sy >= 0
    top = int(sy[real].min()) if real.any() else 0
    tall = int(sy[real].max()) - top + 1 if real.any() else 1
    values, flags = np.zeros((tall, source_width)), np.full((tall, source_width), MISSING, np.int16)
    at = sy[real] - top, rows["x"].to_numpy()[real]
    values[at] = rows["value"].to_numpy()[real]
    flags[at] = rows["flags"].to_numpy()[real]
    nan = (flags == 0) & ~np.isfinite(values)
    values[(flags != 0) | nan] = 0.0
    out, seen = np.full(count * width, np.nan), np.full(count * width, MISSING, np.int16)
    x = np.tile(np.arange(width, dtype=np.float64), count)
    y = np.repeat(np.arange(y0, y0 + count, dtype=np.float64), width)
    u, v = transform.inverse().apply(x, y)
    left, wx, full_x = _axis(u, source_width)
    high, wy, full_y = _axis(v, source_height)
    good = np.flatnonzero(full_x & full_y)
    left, high, wx, wy = left[good].astype(np.int64), high[good].astype(np.int64) - top, wx[good], wy[good]
    total, bottom = np.zeros(len(good)), np.zeros(len(good))
    met, bad, lost = np.zeros(len(good), np.int16), np.zeros(len(good), bool), np.zeros(len(good), bool)
    for j in range(6):
        for i in range(6):
            w = wy[:, j] * wx[:, i]
            used = w != 0
            row, column = high + j, left + i
            here = used & (row >= 0) & (row < tall)
            r, c = np.clip(row, 0, tall - 1), np.clip(column, 0, source_width - 1)
            flag = np.where(here, flags[r, c], np.where(used, MISSING, 0))
            total += np.where(here, w * values[r, c], 0.0)
            bottom += np.where(used, w, 0.0)
            met |= flag.astype(np.int16)
            lost |= here & nan[r, c]
            bad |= flag != 0
    bad |= lost | (np.abs(bottom) < LEAST_WEIGHT)
    fine = ~bad
    out[good[fine]] = total[fine] / bottom[fine]
    seen[good[fine]] = 0
    seen[good[bad]] = met[bad] | MISSING | np.where(lost[bad], INVALID, 0).astype(np.int16)
    return out, seen


def _bands(width: int, height: int, transform: Affine | Projective, band_rows: int) -> list[tuple[int, int, int]]:
    """``(first row, top, bottom)`` of each band of the output; top and bottom bound the source rows that it needs."""
    bands = []
    for y0 in range(0, height, band_rows):
        window = source_window(width, height, transform, y0, min(band_rows, height - y0))
        bands.append((y0, *((window[0], window[2]) if window else (0, -1))))
    return bands


def resample(source: DataFrame, source_width: int, source_height: int, width: int, height: int, transform: Affine | Projective | dict[int, Affine | Projective], band_rows: int = 256) -> DataFrame:
    """Frames (stack_id, frame_id, plane) resampled to the reference grid; positions without full clean support are NaN.

    ``transform`` is one for all frames, or one for each ``frame_id``: the frames of a plan take one scan and one shuffle
    together, and frames that the plan does not name are left out.  All taps that weigh must be inside and clean.  A bad
    tap passes its flags on with MISSING; a position off the source is MISSING alone.
    """
    require(width > 0 and height > 0 and band_rows > 0, "the output needs a positive size")
    names = [*IMAGE, "y", "x", "value", "flags"]
    sent = source.select(*names[:-1], F.coalesce("flags", F.lit(0)).cast("short").alias("flags"))
    # One marker per band and image: a band that needs no source row still has positions.
    marks = source.select(*IMAGE).distinct()
    blank = [F.lit(-1).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("value"), F.lit(0).cast("short").alias("flags")]
    if isinstance(transform, dict):
        rows = [(f, *band) for f, t in transform.items() for band in _bands(width, height, t, band_rows)]
        bands = source.sparkSession.createDataFrame(rows, "_frame long, band int, top int, bottom int")
        if len(rows) <= SMALL_PLAN:
            bands = F.broadcast(bands)
        own = F.col("frame_id") == F.col("_frame")
        sent = sent.join(bands, own & F.col("y").between(F.col("top"), F.col("bottom"))).select(*names, "band")
        marks = marks.join(bands, own).select(*IMAGE, *blank, "band")
    else:
        bands = _bands(width, height, transform, band_rows)
        known = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(t).alias("top"), F.lit(e).alias("bottom")) for b, t, e in bands])
        needed = F.filter(known, lambda b: F.col("y").between(b["top"], b["bottom"]))
        sent = sent.select(*names, F.explode(F.transform(needed, lambda b: b["band"])).alias("band"))
        marks = marks.select(*IMAGE, *blank, F.explode(F.array(*[F.lit(b[0]) for b in bands])).alias("band"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        stack, frame, plane, y0 = (k.as_py() for k in key)
        count = min(band_rows, height - y0)
        shape = transform[frame] if isinstance(transform, dict) else transform
        value, flags = _band(rows, y0, count, width, shape, source_width, source_height)
        n = count * width
        columns = [np.full(n, stack, np.int32), np.full(n, frame, np.int64), np.full(n, plane, np.int32), np.repeat(np.arange(y0, y0 + count, dtype=np.int32), width), np.tile(np.arange(width, dtype=np.int32), count), value, flags]
        return pa.table([pa.array(c) for c in columns], names=names)

    return sent.unionByName(marks).groupBy(*IMAGE, "band").applyInArrow(run, RESAMPLED)


def common_footprint(spark: SparkSession, width: int, height: int, frames: list[tuple[int, int, Affine | Projective]]) -> DataFrame:
    """Output positions with how many frames ``(source width, source height, transform)`` cover them completely."""
    grid = output_grid(spark, width, height)
    covered = F.lit(0)
    for w, h, transform in frames:
        u, v = transform.inverse().apply(F.col("x").cast("double"), F.col("y").cast("double"))
        covered = covered + F.coalesce(complete(u, w) & complete(v, h), F.lit(False)).cast("int")
    return grid.withColumn("covered", covered).withColumn("common", F.col("covered") == len(frames))


def largest_rectangle(footprint: DataFrame) -> tuple[int, int, int, int] | None:
    """``(top, left, width, height)`` of the largest all-common rectangle; ties go to top, left, width, height.

    Rows are reduced to their runs of common positions before anything reaches the driver, a few numbers per row.
    """
    ok = footprint.filter("common").withColumn("g", F.col("x") - F.row_number().over(W.partitionBy("y").orderBy("x")))
    runs = ok.groupBy("y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select("y", "x0", "x1").toPandas()
    if not len(runs):
        return None
    width, height = int(runs["x1"].max()) + 1, int(runs["y"].max()) + 1
    heights, best = np.zeros(width, np.int64), None
    by_row = {y: g for y, g in runs.groupby("y")}
    for y in range(height):
        row = np.zeros(width, bool)
        for x0, x1 in by_row.get(y, pd.DataFrame(columns=["x0", "x1"]))[["x0", "x1"]].itertuples(index=False):
            row[x0 : x1 + 1] = True
        heights = np.where(row, heights + 1, 0)
        stack: list[tuple[int, int]] = []
        for x, h in enumerate([*heights.tolist(), 0]):
            left = x
            while stack and stack[-1][1] >= h:
                left, tall = stack.pop()
                if tall:
                    found = (-(x - left) * tall, y - tall + 1, left, -(x - left), -tall)
                    best = min(best, found) if best else found
            stack.append((left, h))
    return None if best is None else (best[1], best[2], -best[3], -best[4])


# Gradient-corrected linear demosaicing, offsets (dx, dy) with numerators over a denominator.
GREEN_AT_COLOUR = (8, {(0, 0): 4, (1, 0): 2, (-1, 0): 2, (0, 1): 2, (0, -1): 2, (2, 0): -1, (-2, 0): -1, (0, 2): -1, (0, -2): -1})
OPPOSITE_COLOUR = (16, {(0, 0): 12, (1, 1): 4, (-1, 1): 4, (1, -1): 4, (-1, -1): 4, (2, 0): -3, (-2, 0): -3, (0, 2): -3, (0, -2): -3})
COLOUR_IN_ROW = (16, {(0, 0): 10, (1, 0): 8, (-1, 0): 8, (2, 0): -2, (-2, 0): -2, (1, 1): -2, (-1, 1): -2, (1, -1): -2, (-1, -1): -2, (0, 2): 1, (0, -2): 1})
PATTERNS = {"RGGB": (0, 1, 1, 2), "BGGR": (2, 1, 1, 0), "GRBG": (1, 0, 2, 1), "GBRG": (1, 2, 0, 1)}


def sampled_channel(pattern: str, y: Column, x: Column) -> Column:
    """0 red, 1 green, 2 blue, by the parity of the position."""
    require(pattern in PATTERNS, "pattern must be RGGB, BGGR, GRBG or GBRG")
    phase = (y.bitwiseAND(F.lit(1)) * 2 + x.bitwiseAND(F.lit(1))).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in PATTERNS[pattern]]), phase + 1)


def kernel_taps(pattern: str) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
    """``(dx, dy, weight)`` of the up to 11 taps of each phase and channel."""
    out = {}
    for phase, sampled in enumerate(PATTERNS[pattern]):
        beside = PATTERNS[pattern][phase ^ 1]  # the colour next to this position in its row
        for channel in range(3):
            if channel == sampled:
                out[phase, channel] = [(0, 0, 1.0)]
                continue
            if channel == 1:
                kernel, turned = GREEN_AT_COLOUR, False
            elif sampled == 1:
                kernel, turned = COLOUR_IN_ROW, beside != channel
            else:
                kernel, turned = OPPOSITE_COLOUR, False
            out[phase, channel] = [(*((dy, dx) if turned else (dx, dy)), n / kernel[0]) for (dx, dy), n in kernel[1].items()]
    return out


def reflect(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whole-sample symmetric reflection into 0..length-1."""
    last = length - 1
    return np.where(last == 0, 0, last - np.abs(np.mod(c, 2 * np.maximum(last, 1)) - last))


#: Positions along a side of a tile, and how far the taps reach.
TILE, REACH = 16, 2
TILED = ("stack_id", "frame_id", "ty", "tx")


def _mosaic_tiles(columns: list[np.ndarray], taps: dict[tuple[int, int], list[tuple[int, int, float]]]) -> pa.RecordBatch:
    """The three planes of whole tiles whose rows are adjacent, many tiles at a time."""
    stack, frame, ty, tx, y, x, value, flags, h, w = columns
    if (y < 0).any() or (x < 0).any():
        raise ValueError("positions must not be negative")
    wide = TILE + 2 * REACH
    tile = np.cumsum(np.concatenate([[0], _changes(columns[:4])]))
    place = lambda row, column, at: ((tile[at] * wide) + row - ty[at] * TILE + REACH) * wide + column - tx[at] * TILE + REACH
    cell, cells = place(y, x, slice(None)), (int(tile[-1]) + 1) * wide * wide
    nan = (flags == 0) & ~np.isfinite(value)
    wrong = (flags != 0) | nan
    there = np.bincount(cell, minlength=cells)
    total = np.bincount(cell, np.where(wrong, 0.0, value), minlength=cells)
    bad = (np.bincount(cell, wrong, minlength=cells) > 0) | (there == 0)
    lost = np.bincount(cell, nan, minlength=cells) > 0
    seen = np.zeros(cells, np.int64)
    np.bitwise_or.at(seen, cell, flags.astype(np.int64))
    own = np.flatnonzero((y // TILE == ty) & (x // TILE == tx))
    own = own[np.unique(cell[own], return_index=True)[1]]
    phase, parts = (y[own] & 1) * 2 + (x[own] & 1), []
    for (k, channel), kernel in taps.items():
        at = own[phase == k]
        top, void, met, none = np.zeros(len(at)), np.zeros(len(at), bool), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        for dx, dy, weight in kernel:
            c = place(reflect(y[at] + dy, h[at]), reflect(x[at] + dx, w[at]), at)
            top += weight * total[c]
            void |= bad[c]
            met |= seen[c]
            none |= lost[c]
        # a position that is there twice counts twice, as each of its taps does
        top = np.where(void, np.nan, top * there[cell[at]])
        parts.append((stack[at], frame[at], np.full(len(at), channel, np.int32), y[at], x[at], top, np.where(void, met | MISSING | np.where(none, INVALID, 0), 0).astype(np.int16)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=[*IMAGE, "y", "x", "value", "flags"])


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        out |= k[1:] != k[:-1]
    return out


def demosaic(samples: DataFrame, pattern: str) -> DataFrame:
    """Three planes from one mosaic plane: one shuffle by frames, then an Arrow kernel over tiles with the taps around them.

    One bad tap voids the sample: NaN, all flags seen, and MISSING.  Memory is that of a batch, whatever the size of a frame.
    """
    require(pattern in PATTERNS, "pattern must be RGGB, BGGR, GRBG or GBRG")
    keys, whole = ["stack_id", "frame_id"], W.partitionBy("stack_id", "frame_id")
    side = samples.filter("stack_id IS NOT NULL AND frame_id IS NOT NULL").select(*keys, "y", "x", "value", F.coalesce("flags", F.lit(0)).cast("int").alias("flags")).repartition(*keys)
    side = side.withColumns({"h": F.max("y").over(whole) + 1, "w": F.max("x").over(whole) + 1})
    for c, size, tile in (("y", "h", "ty"), ("x", "w", "tx")):
        first, last = F.greatest(F.col(c) - REACH, F.lit(0)), F.least(F.col(c) + REACH, F.col(size) - 1)
        side = side.withColumn(tile, F.explode(F.sequence(*[F.floor(k / TILE).cast("int") for k in (first, F.greatest(first, last))])))
    sent = side.select(*TILED, "y", "x", "value", "flags", "h", "w").sortWithinPartitions(*TILED)
    taps = kernel_taps(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(c) for c in zip(held, own, strict=True)] if held else own
            ends = np.flatnonzero(_changes(held[:4])) + 1
            if len(ends):
                yield _mosaic_tiles([c[: ends[-1]] for c in held], taps)
                held = [c[ends[-1] :].copy() for c in held]
        if held and len(held[0]):
            yield _mosaic_tiles(held, taps)

    kinds = {c: samples.schema[c].dataType.simpleString() for c in (*keys, "y", "x")}
    return sent.mapInArrow(run, f"stack_id {kinds['stack_id']}, frame_id {kinds['frame_id']}, plane int, y {kinds['y']}, x {kinds['x']}, value double, flags smallint")
